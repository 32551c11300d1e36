"""Operator 10, chat formatting by schema fingerprints.

Records of any layout (prompt and answer, instruction, input and output, lists of messages, single
message rows) are recognised by a fingerprint: the hash of the sorted nested field paths that hold a
value. Each known fingerprint selects a declarative mapping, a list of (role, paths) rules, which turns
the record into canonical turns. The template then marks turns and escapes control strings in texts,
reversibly, and gives the spans of the loss mask: the texts of the assistant.

Conversations are streamed turn by turn in sorted partitions, so a conversation of any length needs
the memory of one turn. Turns are ordered by turn (null first), then role and text. A null text or
role counts as empty; a null conversation id is a conversation of its own. A layout without a mapping
gives no turns and is reported as such. Roles of message rows stay as they are. Repeated rows are turns of their own; ties in
turn go by role and text; empty tables give no rows; other columns are ignored. A text of any length is one turn, held whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import small_batches

# The template's control strings. In texts, ESCAPE stands before each of their first characters and before itself.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "\\"
#: Strings with a meaning for common chat models; escaped too, so that no text can open or close a turn there.
CONTROL = (OPEN, BODY, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_ESCAPED = re.compile(re.escape(ESCAPE) + f"({re.escape(ESCAPE)}|" + "|".join(re.escape(c[0] + ESCAPE + c[1:]) for c in CONTROL) + ")")

#: Mappings by layout: for each kind of record its field paths and its rules. A rule takes the role from a constant, from a
#: path (@) or, by its name in ROLES, from a path (~), and joins the texts at its paths; paths through lists ([]) give a turn for each item.
LAYOUTS: dict[tuple[str, ...], list[tuple[str, tuple[str, ...]]]] = {
    ("role", "text"): [("@role", ("text",))],
    ("role", "content"): [("@role", ("content",))],
    ("messages[].content", "messages[].role"): [("@messages[].role", ("messages[].content",))],
    ("conversations[].from", "conversations[].value"): [("~conversations[].from", ("conversations[].value",))],
    ("prompt", "response"): [("user", ("prompt",)), ("assistant", ("response",))],
    ("completion", "prompt"): [("user", ("prompt",)), ("assistant", ("completion",))],
    ("answer", "question"): [("user", ("question",)), ("assistant", ("answer",))],
    ("instruction", "output"): [("user", ("instruction",)), ("assistant", ("output",))],
    ("input", "instruction", "output"): [("user", ("instruction", "input")), ("assistant", ("output",))],
    ("prompt", "response", "system"): [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))],
}
#: Other names of roles, in layouts that use them.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(record, prefix: str = "") -> set[str]:
    """Nested field paths that hold a value other than null; lists add [] to theirs."""
    if isinstance(record, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in record.items()))
    if isinstance(record, list):
        return set().union(*(paths(v, f"{prefix}[]") for v in record))
    return set() if record is None else {prefix}


def fingerprint(field_paths) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(layout): rules for layout, rules in LAYOUTS.items()}
NAMED = frozenset(p for layout in LAYOUTS for p in layout)


@lru_cache(4096)
def mapping(field_paths: frozenset[str]) -> list[tuple[str, tuple[str, ...]]] | None:
    """The rules that the fingerprint of these paths selects. Fields that no layout names (ids, dates) don't count."""
    return MAPPINGS.get(fingerprint(field_paths & NAMED))


def _values(record, path: str) -> list:
    head, _, rest = path.partition(".")
    many = head.endswith("[]")
    value = record.get(head.removesuffix("[]")) if isinstance(record, dict) else None
    items = value if many and isinstance(value, list) else [value]
    return [v for i in items for v in (_values(i, rest) if rest else [i])]


def turns(record: dict) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of a record, or None if no mapping has its fingerprint."""
    rules = mapping(frozenset(paths(record)))
    if rules is None:
        return None
    out = []
    for role, places in rules:
        columns = [_values(record, p) for p in places]
        roles = _values(record, role[1:]) if role[0] in "@~" else [role] * len(columns[0])
        for r, *texts in zip(roles, *columns, strict=False):
            out.append((ROLES.get(r, r or "") if role[0] == "~" else r or "", "\n".join(str(t) for t in texts if t not in (None, ""))))
    return out


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + (m[0] if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == ESCAPE else m[1][0] + m[1][2:], text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A formatted turn, and the span of it that is under the loss mask."""
    head = OPEN + escape(role) + BODY
    body = escape(text)
    return head + body + CLOSE + "\n", (len(head), len(head) + len(body)) if role == "assistant" else None


_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text: the inverse of the template."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_records(records: DataFrame, layout: str = "record") -> DataFrame:
    """``records`` (JSON text column ``layout``) with formatted text, its loss spans and the record's fingerprint.

    Malformed JSON, non-objects, nulls and unknown layouts give null text and no spans.
    """
    small_batches(records.sparkSession)

    @F.pandas_udf("fingerprint string, formatted string, loss array<struct<start:int,end:int>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch:
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                found = turns(record) if isinstance(record, dict) else None
                mark = fingerprint(paths(record)) if isinstance(record, dict) else None
                text, spans = "", []
                for piece, span in (format_turn(*t) for t in found or ()):
                    if span:
                        spans.append({"start": len(text) + span[0], "end": len(text) + span[1]})
                    text += piece
                rows.append((mark, None if found is None else text, spans))
            yield pd.DataFrame(rows, columns=["fingerprint", "formatted", "loss"])

    return records.withColumn("chat", apply(F.col(layout)))


def format_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Message rows -> one row per turn: conv_id, seq, formatted, loss_start, loss_end (null outside the mask).

    Each row is a record of the single-message layout and goes through the same fingerprint and mapping.
    The rows of a conversation are in one partition, in order; the concatenation of ``formatted`` in
    order of seq is the formatted conversation.
    """
    small_batches(rows.sparkSession)
    picked = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seq = object(), 0
        for batch in batches:
            out = []
            for c, r, t in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"], strict=True):
                same = (c is pd.NA and current is pd.NA) or (c is not pd.NA and current is not pd.NA and c == current)
                current, seq = c, seq + 1 if same else 0
                for piece, span in (format_turn(*x) for x in turns({"role": r, "text": t})):
                    out.append((c, seq, piece, *(span or (None, None))))
            frame = pd.DataFrame(out, columns=["conv_id", "seq", "formatted", "loss_start", "loss_end"])
            yield frame.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    return dealt.mapInPandas(apply, "conv_id long, seq long, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the output of ``format_rows`` back, in its order, into one row per conversation with digests."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def row() -> tuple:
            conv, n, whole, loss, chars, size = state
            return conv, n, whole.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            out = []
            columns = (batch[c].astype("Int64") if c != "formatted" else batch[c] for c in ("conv_id", "seq", "formatted", "loss_start", "loss_end"))
            for conv, seq, piece, a, b in zip(*columns, strict=True):
                if seq == 0:
                    if state:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text in read_turns(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if a is not pd.NA:
                    masked = unescape(piece[a:b])
                    state[3].update(masked.encode())
                    state[4] += len(masked)
                state[5] += len(piece)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return formatted.mapInPandas(apply, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
