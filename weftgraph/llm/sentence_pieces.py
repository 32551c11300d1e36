"""Operator 6, exact SentencePiece encoding of merge-type models by backtracking, and decoding.

The encoder walks a text with the longest pieces that match, found by an Aho-Corasick automaton over
the vocabulary. A piece may follow another only if merging the two anew gives back the same two, which is seen from
the merges that each goes through by itself; if no piece fits, the last one is taken back for its next shorter one,
and a bitfield remembers the places from which no way leads on, so that each is tried once. Text is first cut wherever
no piece holds the two neighbouring characters, so equal words are encoded once per worker.

Null texts count as empty and give the end id alone. Characters outside the vocabulary become byte
pieces. Ids come as text, separated by one space. Of merges with equal scores, the leftmost goes first. A text of any length is coded whole, word
by word. Repeated rows each get their result; empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from math import inf
from operator import add

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import Memo, per_worker, small_batches, trimmed

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
RESULT = T.StructType([T.StructField("ids", T.StringType()), T.StructField("n_ids", T.LongType()), T.StructField("decoded", T.StringType())])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffers message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[i : i + n]
            i += n


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces (text, score, type) and the settings that encoding depends on, from a .model file's bytes."""
    import struct

    pieces, settings = [], {"type": 1, "end": 2, "byte_fallback": False, "prefix": True, "squeeze": True, "map": b""}
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append((text, score, kind))
        elif number == 2:
            named = {3: "type", 35: "byte_fallback", 42: "end"}
            settings |= {named[n]: v for n, v in _fields(value) if n in named}
        elif number == 3:
            named = {2: "map", 3: "prefix", 4: "squeeze"}
            settings |= {named[n]: v for n, v in _fields(value) if n in named}
    return pieces, settings


class Encoder:
    """Encodes and decodes with a merge-type (BPE) model; see the module text."""

    def __init__(self, data: bytes):
        self.pieces, s = read_model(data)
        if s["type"] != 2 or s["map"] or s["squeeze"] or not s["byte_fallback"] or any(k in (USER, UNUSED) for _, _, k in self.pieces):
            raise ValueError("only merge-type models with byte fallback, without normalization rules or user-defined or unused pieces")
        self.prefix, self.end = bool(s["prefix"]), s["end"]
        self.ids = {t: i for i, (t, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.scores = {t: self.pieces[i][1] for t, i in self.ids.items()}
        self.bytes = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(self.pieces) if k == BYTE}
        self.together = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        scored: dict[float, set[str]] = {}
        for t, x in self.scores.items():
            if len(t) > 1:
                scored.setdefault(x, set()).add(t)
        #: pieces that share their score: merges among them go by place, not by rank, so pairs don't decide
        self.tied = {t for ts in scored.values() if len(ts) > 1 for t in ts}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        self.tied_starts = {t[:2] for t in self.tied}
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            if len(t) > 1:  # a character always counts
                self.automaton.add_word(t, (len(t) - 1, self._prefixes(t)))
        self.automaton.make_automaton()
        self.fits = Memo(self._fits, 32 << 20)
        self.single = Memo(lambda c: (c,))
        self.left, self.right = Memo(lambda p: self._edge(p, 0)), Memo(lambda p: self._edge(p, -1))
        self.words = Memo(lambda w: self._word(SPACE + w), 64 << 20)  # by what follows a space
        self.parts = Memo(self._part, 32 << 20)
        self.texts = {t: str(i) for t, i in self.ids.items()}
        table = {str(i): t.replace(SPACE, " ") if k == NORMAL else "" for i, (t, _, k) in enumerate(self.pieces)}
        table |= {str(i): chr(b) if b < 0x80 else chr(0xDC00 + b) for b, i in self.bytes.items()}
        table |= {str(i): " ⁇ " for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN}
        self.table = table

    # encoding

    def merge(self, text: str, made: list[tuple[float, str, str]] | None = None) -> list[str]:
        """Merges by score, leftmost first: the definition; used on single and on tied pieces, and where merges of a piece aren't in order of score.

        made: gets the cost of each merge, in their order, with the first and the last part after it.
        """
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []
        end = len(parts) - 1  # where the last part is

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (x := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-x, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            cost, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            if j == end:
                end = i
            if made is not None:
                made.append((cost, parts[0], parts[end]))
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _edge(self, piece: str, side: int) -> tuple[list[str], list[float]] | None:
        """What stands first (side 0) or last (-1) in a piece while its characters merge, and the costs of the merges that end each; None if it isn't merged whole, in order of cost."""
        made: list[tuple[float, str, str]] = []
        if self.merge(piece, made) != [piece] or any(a[0] > b[0] for a, b in zip(made, made[1:])):
            return None
        parts, ends = [piece[side]], []
        for cost, *sides in made:
            if sides[side] != parts[-1]:
                parts.append(sides[side])
                ends.append(cost)
        return parts, [*ends, inf]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether merging the two pieces anew gives them back: no merge across their border comes before the next one on either side of it (on the left: or with it)."""
        a, b = (self.right[pair[0]] if pair[0] else None), self.left[pair[1]]
        if a is None or b is None:
            return self.merge(pair[0] + pair[1]) == [p for p in pair if p]
        (before, until), (behind, till), i, j, scores = a, b, 0, 0, self.scores
        while True:
            score = scores.get(before[i] + behind[j])
            if score is not None and -score < until[i] and -score <= till[j]:
                return False
            if until[i] <= till[j]:
                if until[i] == inf:
                    return True
                i += 1
            else:
                j += 1

    def _prefixes(self, piece: str) -> tuple[str, ...]:
        """The piece and all pieces that it begins with, longest first; its first character always counts."""
        return tuple(p for n in range(len(piece), 0, -1) if (p := piece[:n]) in self.ids or n == 1)

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text without tied pieces."""
        longest = list(map(self.single.__getitem__, text))
        for stop, (more, options) in self.automaton.iter(text):  # in order of stop, so the last one of a start is the longest
            longest[stop - more] = options
        found, at, last, fits = [], 0, "", self.fits
        while at < len(text):  # most parts need no way back
            for piece in longest[at]:
                if fits[last, piece]:
                    break
            else:
                return self._way(longest)
            found.append(piece)
            at += len(piece)
            last = piece
        return found

    def _way(self, longest: list[tuple[str, ...]]) -> list[str]:
        """The pieces of a text, by the longest matches of its places and their prefixes, where a choice has to be taken back."""
        failed = bytearray(len(longest) + 8 >> 3)  # bit i: no way leads on from place i
        path: list[tuple[int, int]] = []  # place, and number of the choice among the prefixes of the longest match
        at, choice, last, length, fits = 0, 0, "", len(longest), self.fits
        while at < length:
            options = longest[at]
            while choice < len(options):
                piece = options[choice]
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1 and fits[last, piece]:
                    break
                choice += 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    raise ValueError("the model's merges don't reach all of its pieces")
                at, choice = path.pop()
                choice += 1
                last = longest[path[-1][0]][path[-1][1]] if path else ""
                continue
            path.append((at, choice))
            at, choice, last = to, 0, piece
        return [longest[i][c] for i, c in path]

    def _part(self, part: str) -> str:
        """Ids, as text, of a part within which all neighbouring characters share some piece."""
        tied = any(t in part for t in self.tied_starts) and any(t in part for t in self.tied)
        known = self.texts.get
        return " ".join([known(p) or " ".join([str(self.bytes[b]) for b in p.encode()]) for p in (self.merge(part) if tied else self.backtrack(part))])

    def _word(self, word: str) -> str:
        """Ids of a word: nothing merges across two characters that are together in no piece."""
        parts, found, start = self.parts, [], 0
        inside = list(map(self.together.__contains__, map(add, word, word[1:])))
        if False not in inside:
            return parts[word]
        for i, fine in enumerate(inside, 1):
            if not fine:
                found.append(parts[word[start:i]])
                start = i
        found.append(parts[word[start:]])
        return " ".join(found)

    def encode(self, text: str) -> str:
        """Ids of a text and the end id, as text with one space between."""
        if not text:
            return str(self.end)
        first, *rest = text.replace(SPACE, " ").split(" ")
        words = self.words
        if self.prefix and first and "" not in rest:
            return " ".join([words[first], *map(words.__getitem__, rest), str(self.end)])
        found, spaces = [], int(self.prefix)
        for p in (first, *rest):  # a run of spaces goes with the word after it: no piece holds a space after another character
            if p:
                found.append(words[p] if spaces == 1 else self._word(SPACE * spaces + p))
                spaces = 0
            spaces += 1
        if spaces > 1:
            found.append(self._word(SPACE * (spaces - 1)))
        return " ".join([*found, str(self.end)])

    # decoding

    def decode(self, ids: str) -> str:
        """Text of ids given as text; a prefix space is taken off, bytes that are no UTF-8 become replacement characters."""
        text = "".join(map(self.table.__getitem__, ids.split(" "))) if ids else ""
        if self.prefix and text.startswith(" "):
            text = text[1:]
        try:
            text.encode()
            return text
        except UnicodeEncodeError:
            return text.encode("utf-8", "surrogateescape").decode("utf-8", "weftgraph-each-byte")


codecs.register_error("weftgraph-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def coder(docs: DataFrame, path: str):
    """A column function: text -> struct(ids, n_ids, decoded). The file is read on the driver; its size bounds the broadcast."""
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(RESULT)
    @trimmed
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = per_worker(("pieces", path), lambda: Encoder(shared.value))
        for texts in batches:
            ids = [encoder.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": ids, "n_ids": [x.count(" ") + 1 for x in ids], "decoded": [encoder.decode(x) for x in ids]})

    return code


def sentence_pieces(docs: DataFrame, path: str, text: str | Column = "text") -> DataFrame:
    """``docs`` with a struct column ``pieces`` (ids, n_ids, decoded), replacing one of that name."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return docs.withColumn("pieces", coder(docs, path)(column))
