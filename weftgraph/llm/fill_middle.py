"""Fill-in-middle transformation: a text's middle is moved behind its suffix, so that a model learns to fill gaps.

Cuts are offsets of whole units, here code points: one fullmatch of ``(unit)*`` by the regex library keeps the end of every repetition,
so that ``ends(1)`` gives their number and both offsets. Numbers derived from a hash of the key choose cuts and form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, beside_row, from_row, small_batches, trimmed

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: One code point of any kind; ``ends(1)`` of a full match lists where each one ends.
UNITS = regex.compile("(.)*", regex.DOTALL)
#: Code points matched at once: all of nearly every text. A longer one is matched piece by piece, so that the captures stay bounded.
PIECE = 1 << 18


@dataclass(frozen=True)
class Form:
    """How texts are transformed: markers, shares in percent of plain texts and, of the others, of suffix first; ``salt`` goes before the key in the hash."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    spm_percent: int = 20
    salt: str = "1:"


def draws(key: Column, salt: str) -> Column:
    """Four numbers below 2^32 from the sha256 of salt and key as text (null: no text)."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def unit_ends(text: str) -> Iterator[list[int]]:
    """Where each unit of the text ends, a list for each piece."""
    for at in range(0, max(len(text), 1), PIECE):
        ends = UNITS.fullmatch(text, at, at + PIECE).ends(1)
        yield ends


def cut_at(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """(units, offset of the first cut, offset of the second), cuts being after h1 and h2 modulo units + 1 units."""
    pieces = list(unit_ends(text)) if len(text) <= PIECE else None
    n = len(pieces[0]) if pieces else sum(map(len, unit_ends(text)))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    offsets, seen = [0, 0], 0
    for ends in pieces or unit_ends(text):
        for i, units in enumerate((low, high)):
            if seen < units <= seen + len(ends):
                offsets[i] = ends[units - seen - 1]
        seen += len(ends)
    return n, *offsets


def fill_in_middle(docs: DataFrame, key: str = "doc_id", form: Form = Form()) -> DataFrame:
    """A struct column ``fim`` beside the columns of ``docs``: n, form, prefix_chars, middle_chars and output.

    Plain texts (empty, with a marker inside, or drawn so) stay as they are and have no cuts; a null text is an empty one. Equal keys get equal draws,
    a null key those of no text. Rows are independent: repeated rows, ties and an empty table need nothing special; a text of any
    length is cut as a whole. Other columns come through untouched, whatever they are called.
    """
    small_batches(docs.sparkSession)
    shape = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
    marks = (form.prefix, form.suffix, form.middle)

    def one(text: str, h: list[int]) -> dict:
        n, a, b = cut_at(text, h[0], h[1])
        if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - form.plain_percent:
            return {"n": n, "form": PLAIN, "prefix_chars": None, "middle_chars": None, "output": text}
        before, middle, after = text[:a], text[a:b], text[b:]
        if h[3] % 100 < form.spm_percent:
            kind, output = SPM, f"{form.suffix}{after}{form.prefix}{before}{form.middle}{middle}"
        else:
            kind, output = PSM, f"{form.prefix}{before}{form.suffix}{after}{form.middle}{middle}"
        return {"n": n, "form": kind, "prefix_chars": len(before), "middle_chars": len(middle), "output": output}

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for batch in batches:
            made = [one(t or "", h) for t, h in zip(batch.column("text").to_pylist(), batch.column("draws").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, type_)], ["row", "fim"])

    packed = docs.select(as_row(docs), docs["text"].alias("text"), draws(docs[key], form.salt).alias("draws"))
    return from_row(packed.mapInArrow(run, beside_row(packed, "fim", shape)), docs.columns, "fim")


def restored(output: Column, kind: Column, form: Form = Form()) -> Column:
    """The text once more, from output and form alone: transformed texts hold each marker just once."""
    quoted = "|".join("\\Q" + m + "\\E" for m in (form.prefix, form.suffix, form.middle))
    part = F.split(output, quoted, -1)  # nothing, then the three parts in order of the form
    return F.when(kind == PSM, F.concat(part[1], part[3], part[2])).when(kind == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)
