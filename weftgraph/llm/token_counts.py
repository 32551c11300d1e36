"""Operator 5, token counts by finite-state tokenizer compilation.

Two deterministic machines are compiled from a byte-level BPE tokenizer file.

* ``SPLITTER`` reads character classes and marks where a word (a pre-token) begins. It has a handful
  of states, so each chunk of a text has a state map (start state -> end state); the maps compose
  associatively and a parallel prefix scan gives every chunk's start state. Chunks are numpy lanes.
* ``MergeTransducer`` reads the bytes of a word. Its states are compiled on demand from the merge
  rules; each transition is annotated with the change of the number of tokens, so that the number
  of tokens of any prefix is the sum along its path. Words that were met are kept as single
  transitions with their whole count.

Counts equal those of the tokenizer library for the same file, special strings inside a text included
(each is one token). Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each; empty tables give no rows; ties don't
arise; other columns are left alone. A text of any length is handled whole, words in slices of bounded number.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import Memo, per_worker, slices, small_batches, trimmed

# Symbols that the splitter reads: a character's class, told apart by what follows it.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, SPACE_MORE, WHITE_LAST, WHITE_MORE, BEGIN, NOTHING = range(11)
# Its states: at a word's start; in letters, numbers, others; after a space that belongs to the next
# word; in white space; in a contraction with one or two letters to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
#: Characters of one lane of the scan.
LANE = 64
#: Words that are sliced from a text at once.
WORDS_AT_ONCE = 200_000


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables [symbol, state] of the next state and of whether a word begins before the symbol."""
    to = np.zeros((11, 8), np.uint8)
    begins = np.zeros((11, 8), bool)
    for state in range(8):
        runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
        for symbol, run in runs.items():
            to[symbol, state], begins[symbol, state] = run, state not in (run, AFTER_SPACE)
        if state in (ONE_LEFT, TWO_LEFT):
            to[LETTER, state], begins[LETTER, state] = (START if state == ONE_LEFT else ONE_LEFT), False
        for symbol, rest in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            joins = state in (IN_OTHERS, AFTER_SPACE)
            to[symbol, state], begins[symbol, state] = (IN_OTHERS if joins else rest), not joins
        to[SPACE_LAST, state], begins[SPACE_LAST, state] = AFTER_SPACE, True
        to[WHITE_LAST, state], begins[WHITE_LAST, state] = START, True
        for symbol in (SPACE_MORE, WHITE_MORE):
            to[symbol, state], begins[symbol, state] = IN_WHITE, state != IN_WHITE
        to[BEGIN, state], begins[BEGIN, state] = START, True
        to[NOTHING, state] = state
    return to, begins


NEXT, BEGINS = _splitter()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: LETTER, NUMBER, OTHER, or WHITE_LAST for white space."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            kinds[code] = LETTER if kind == "L" else NUMBER
    for code in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        kinds[code] = WHITE_LAST
    return kinds


def symbols(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The splitter's symbols for code points; ``begin`` holds the places that stand for a text's begin."""
    s = _classes()[codes]
    s[begin] = BEGIN
    white = s == WHITE_LAST
    more = np.zeros(len(s), bool)
    more[:-1] = (white | (s == BEGIN))[1:]
    more[-1:] = True
    blank = codes == 0x20
    s[white & blank] = SPACE_LAST
    s[white & more] = WHITE_MORE
    s[white & more & blank] = SPACE_MORE
    quote = np.flatnonzero((codes == 0x27) & (s == OTHER))
    if len(quote):
        padded = np.concatenate([np.where(s == BEGIN, 0, codes), [0, 0]])
        a, b = padded[quote + 1], padded[quote + 2]
        s[quote[np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        s[quote[long]] = LONG
    return s


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Prefix scan of state maps [lane, state]: row i becomes the composition of rows 0 to i, by doubling."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def word_starts(s: np.ndarray) -> np.ndarray:
    """Places where words begin: lanes make their state maps, the scan gives start states, lanes then mark words."""
    lanes = -(-len(s) // LANE)
    grid = np.full(lanes * LANE, NOTHING, np.uint8)
    grid[: len(s)] = s
    columns = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    flat = NEXT.ravel()
    for column in columns:
        maps = flat[(column.astype(np.int64) * 8)[:, None] + maps]
    scanned = compose_scan(maps)
    state = np.zeros(lanes, np.uint8)
    state[1:] = scanned[:-1, START]
    marks = np.zeros((LANE, lanes), bool)
    for j, column in enumerate(columns):
        at = column.astype(np.int64) * 8 + state
        marks[j] = BEGINS.ravel()[at]
        state = flat[at]
    return np.flatnonzero(marks.T.ravel()[: len(s)])


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTransducer:
    """Counts tokens of a word by transitions over bytes, compiled from merge rules when first needed.

    A state lists what a later byte may still depend on: for each earlier place from which a token
    could still be under way, the node of the token trie reached from there, the token that ends at
    that place, and the number of tokens up to there, less the number now. A place's tokenization is
    the only one whose neighbouring tokens are compatible, that is: merging the two anew gives them back. That is seen from
    the merges that each goes through by itself.
    """

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]], most: int = 500_000):
        self.tokens, self.merges, self.most = tokens, merges, most  # most: transitions kept
        self.text = {i: t for t, i in tokens.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, i in tokens.items():
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][b]
            self.ends[node] = i
        self.compatible = Memo(self._compatible, 32 << 20)
        self.left, self.right = Memo(lambda t: self._edge(t, 0)), Memo(lambda t: self._edge(t, -1))
        self.clear()

    def clear(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.items = {first: 0}, [first]
        self.table: dict[int, tuple[int, int]] = {}

    def merged(self, ids: list[int], made: list[tuple[int, int, int]] | None = None) -> list[int]:
        """Merge by rank, leftmost first: the definition, used on single tokens, and on pairs where merges of a token aren't in order of rank.

        made: gets the rank of each merge, in their order, with the first and the last token after it.
        """
        while len(ids) > 1:
            best = min(((r[0], i, r[1]) for i in range(len(ids) - 1) if (r := self.merges.get((ids[i], ids[i + 1])))), default=None)
            if best is None:
                break
            ids = [*ids[: best[1]], best[2], *ids[best[1] + 2 :]]
            if made is not None:
                made.append((best[0], ids[0], ids[-1]))
        return ids

    def _edge(self, token: int, side: int) -> tuple[list[int], list[float]] | None:
        """What stands first (side 0) or last (-1) in a token while its bytes merge, and the ranks of the merges that end each; None if it isn't merged whole, in order of rank."""
        made: list[tuple[int, int, int]] = []
        ids = [self.tokens[bytes([b])] for b in self.text[token]]
        if self.merged(ids, made) != [token] or any(a[0] > b[0] for a, b in zip(made, made[1:])):
            return None
        parts, ends = [ids[side]], []
        for rank, *sides in made:
            if sides[side] != parts[-1]:
                parts.append(sides[side])
                ends.append(rank)
        return parts, [*ends, inf]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging the two tokens anew gives them back: no merge across their border comes before the next one on either side of it (on the left: or with it)."""
        left, right = pair
        a, b = (self.right[left] if left >= 0 else None), self.left[right]
        if a is not None and b is not None:
            (before, until), (behind, till), i, j, merges = a, b, 0, 0, self.merges
            while True:
                rank = merges.get((before[i], behind[j]))
                if rank is not None and rank[0] < until[i] and rank[0] <= till[j]:
                    return False
                if until[i] <= till[j]:
                    if until[i] == inf:
                        return True
                    i += 1
                else:
                    j += 1
        both = (self.text[left] if left >= 0 else b"") + self.text[right]
        return self.merged([self.tokens[bytes([b])] for b in both]) == ([left, right] if left >= 0 else [right])

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state by a byte: next state and change of the count."""
        moved, ending = [], None
        for node, last, offset in self.items[state]:
            to = self.children[node].get(byte)
            if to is None:
                continue
            if self.children[to]:
                moved.append((to, last, offset))
            if self.ends[to] >= 0 and ending is None and self.compatible[last, self.ends[to]]:
                ending = (self.ends[to], offset + 1)
        token, change = ending
        after = tuple(sorted((n, t, o - change) for n, t, o in moved) + [(0, token, 0)])
        self.table[state << 8 | byte] = out = (self.number(after), change)
        return out

    def number(self, items: tuple) -> int:
        """The state with these items."""
        if items not in self.states:
            self.states[items] = len(self.items)
            self.items.append(items)
        return self.states[items]

    def count(self, word: bytes) -> int:
        state = total = 0
        get = self.table.get
        for b in word:
            step = get(state << 8 | b)
            if step is None:
                if len(self.table) >= self.most:  # forgets all but the present state
                    items = self.items[state]
                    self.clear()
                    get, state = self.table.get, self.number(items)
                step = self.compile(state, b)
            state, change = step
            total += change
        return total


class TokenCounter:
    """Counts the tokens of texts by a byte-level BPE tokenizer file (.json of the tokenizers library)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, pre = d["model"], d["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or d["normalizer"]:
            raise ValueError("only byte-level BPE with its usual split and without normalizer or prefix space can be compiled")
        letters = _byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        tokens = {as_bytes[t]: i for t, i in model["vocab"].items() if t in as_bytes}
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        self.transducer = MergeTransducer(tokens, merges)
        self.words = Memo(lambda w: self.transducer.count(w.encode()), 64 << 20)
        special = sorted((t["content"] for t in d.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            pieces = [t] if self.special is None or not self.special.search(t) else self.special.split(t)
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        out = extra
        lengths = [len(p) for p in parts]
        for a, b in slices(lengths):
            np.add.at(out, np.array(owner[a:b]), self._count(parts[a:b], lengths[a:b]))
        return out

    def _count(self, texts: list[str], lengths: list[int]) -> np.ndarray:
        begin = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
        whole = "".join("\n" + t for t in texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = word_starts(symbols(codes, begin[:-1]))
        ends = np.append(starts[1:], len(whole))
        totals = np.zeros(len(texts), np.int64)
        words = self.words
        for a in range(0, len(starts), WORDS_AT_ONCE):
            at = starts[a : a + WORDS_AT_ONCE]
            pieces = map(whole.__getitem__, map(slice, at.tolist(), ends[a : a + WORDS_AT_ONCE].tolist()))
            counts = np.fromiter(map(words.__getitem__, pieces), np.int64, len(at))
            text = np.searchsorted(begin, at, side="right") - 1
            counts[at == begin[text]] = 0  # what stands for the begin
            totals += np.bincount(text, counts, len(texts)).astype(np.int64)
        return totals


def counter(docs: DataFrame, path: str):
    """A column function: text -> number of tokens. The file is read on the driver; its size bounds the broadcast."""
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.LongType())
    @trimmed
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = per_worker(("tokens", path), lambda: TokenCounter(shared.value))
        for texts in batches:
            yield pd.Series(machine.count([t or "" for t in texts]))

    return count


def token_counts(docs: DataFrame, path: str, text: str | Column = "text") -> DataFrame:
    """``docs`` with the long columns n_bytes and n_tokens, replacing those of that name."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(column).cast("long"), "n_tokens": counter(docs, path)(column)})
