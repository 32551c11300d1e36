"""A table by key that a stream keeps up to date: what a batch writes is in proportion to the batch, and a batch counts once.

Rows are in runs. A batch adds one run, of the rows it changes; of a key's rows, the newest counts. Runs of a level are merged into one of the next as
soon as there are ``fan`` of them, so a row is written again O(log n) times in all. A run keeps its keys in buckets by hash, with a Bloom filter for each, so that a
batch reads only those buckets of those runs that may hold one of its keys. The list of valid runs is a file for each version, put in place by a
rename after everything else: a crash before it leaves the version before, and the batch, which comes again, writes the same run again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from weftgraph.schema import checkpointed
from weftgraph.sources.files import Folder

#: Bits of the filters for each key, and how many of them a key sets.
BITS, PROBES = 12, 4


def _bits(keys: list[str], n_words: Column) -> Column:
    """The bits of a key in a filter of 64 * n_words: (word, bit)."""
    hashes = [F.pmod(F.xxhash64(*keys, F.lit(probe)), n_words * 64) for probe in range(PROBES)]
    return F.array(*[F.struct(F.shiftright(h, 6).cast("int").alias("word"), (h % 64).cast("int").alias("bit")) for h in hashes])


class KeyedRuns:
    """Rows by ``keys`` under ``path``, with columns of ``schema``. Keys aren't null; the caller numbers versions upwards."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = 64, fan: int = 8):
        self.spark, self.path, self.keys, self.schema, self.buckets, self.fan = spark, path, keys, schema, buckets, fan
        self.folder = Folder(spark, path)

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names("versions"))

    def version(self) -> int | None:
        """The newest version that was committed."""
        return max(self._versions(), default=None)

    def _runs(self, version: int | None) -> list[dict]:
        return [] if version is None else json.loads(self.folder.read(f"versions/{version}"))

    def _publish(self, version: int, runs: list[dict]) -> None:
        self.folder.publish(f"versions/{version}", json.dumps(runs))

    def _written(self, name: str, rows: DataFrame, level: int) -> dict:
        """Writes a run, and the filters of its buckets."""
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        placed.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/runs/run={name}")
        stored = self._stored([{"name": name}])
        filled = stored.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("n_words", F.ceil(F.col("n") * BITS / 64).cast("int"))
        keyed = stored.select("bucket", *self.keys).join(F.broadcast(filled), "bucket")
        ones = keyed.select("bucket", F.inline(_bits(self.keys, F.col("n_words")))).groupBy("bucket", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("ones"))
        blank = filled.select("bucket", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("word"))
        words = blank.join(ones, ["bucket", "word"], "left").groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("ones", F.lit(0)).alias("ones")))), lambda x: x["ones"]).alias("words"))
        words.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/filters/run={name}")
        return {"name": name, "level": level, "rows": filled.agg(F.sum("n")).first()[0] or 0}

    def _stored(self, runs: list[dict], parts: list[tuple[str, int]] | None = None) -> DataFrame:
        """The rows of the runs, or of some of their buckets, with version, run and bucket."""
        paths = [f"{self.path}/runs/run={r['name']}" for r in runs] if parts is None else [f"{self.path}/runs/run={run}/bucket={bucket}" for run, bucket in parts]
        schema = StructType([*self.schema.fields, StructField("version", LongType()), StructField("run", StringType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/runs").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in (*self.schema.names, "version") if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(*self.keys, "x.*")

    def rows(self, version: int | None = None) -> DataFrame:
        """The newest row of each key, as of a version; without one, the newest that was committed."""
        version = self.version() if version is None else version
        return self._newest(self._stored(self._runs(version))).select(*self.schema.names)

    def held(self, wanted: DataFrame) -> DataFrame:
        """The newest row of each of the keys of ``wanted`` that is held. Filters are asked first; only buckets in which a key may be are read."""
        runs = self._runs(self.version())
        if not runs:
            return self._stored([]).select(*self.schema.names)
        filters = self._filters(runs)
        asked = wanted.select(*self.keys).distinct().withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        maybe = F.forall(_bits(self.keys, F.size("words")), lambda x: F.getbit(F.element_at("words", x["word"] + 1), x["bit"]) == 1)
        found = checkpointed(asked.join(filters, "bucket").where(maybe).select(*self.keys, "run", "bucket"))
        parts = [(r["run"], r["bucket"]) for r in found.select("run", "bucket").distinct().collect()]  # at most fan * levels * buckets
        rows = self._stored(runs, sorted(parts)).join(found.drop("bucket"), [*self.keys, "run"], "left_semi")
        return self._newest(rows).select(*self.schema.names)

    def _filters(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema("bucket int, words array<bigint>, run string").option("basePath", f"{self.path}/filters").parquet(*[f"{self.path}/filters/run={r['name']}" for r in runs])

    def commit(self, version: int, rows: DataFrame) -> None:
        """Adds a run of ``rows``, which have each key once, and publishes it. A version that is published already is left as it is."""
        newest = self.version()
        if newest is not None and newest >= version:
            return
        runs = self._runs(newest)
        run = self._written(f"{version}", rows.select(*self.schema.names).withColumn("version", F.lit(version).cast("long")), 0)
        runs = [*runs, run] if run["rows"] else runs
        level = 0
        while sum(r["level"] == level for r in runs) >= self.fan:
            old = [r for r in runs if r["level"] == level]
            merged = self._written(f"{version}-{level + 1}", self._newest(self._stored(old)), level + 1)
            runs, level = [*[r for r in runs if r["level"] != level], merged], level + 1
        self._publish(version, runs)

    def clean(self, keep: int = 2) -> None:
        """Deletes all versions but the newest ``keep``, and runs that none of those needs."""
        versions = self._versions()
        needed = {r["name"] for v in versions[-keep:] for r in self._runs(v)}
        for kind in ("runs", "filters") if versions else ():
            for name in self.folder.names(kind):
                if name.removeprefix("run=") not in needed:
                    self.folder.delete(f"{kind}/{name}")
        for v in versions[:-keep]:
            self.folder.delete(f"versions/{v}")
