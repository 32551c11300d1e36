"""Small files that say which large ones count, on any file system that Hadoop knows. What is published is there as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder of such files."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.path, self._of = path, context._jvm.org.apache.hadoop.fs.Path
        self._system = self._of(path).getFileSystem(context._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._of(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._system.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What is in the folder, or in one below it; nothing if it doesn't exist. Drafts are left out."""
        found = self._system.listStatus(self._at(name)) if self.exists(name) else ()
        return sorted(n for n in (s.getPath().getName() for s in found) if n[0] not in "._")

    def read(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a draft and renames it. A file that is there already stays, which is an error."""
        above, _, last = name.rpartition("/")
        draft = self._at(f"{above}/_{last}" if above else f"_{last}")
        stream = self._system.create(draft, True)
        stream.write(text.encode())
        stream.close()
        if self.exists(name) or not self._system.rename(draft, self._at(name)):
            raise FileExistsError(f"{self.path}/{name} is there already")

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)
