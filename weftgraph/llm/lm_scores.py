"""Language-model scoring: n-gram counts of a corpus in a log-frequency Bloom filter, and texts scored from it.

A count c is kept as its level on a scale of powers of ``base``; an n-gram of level q is put into the filter q times, as (n-gram, 1) to
(n-gram, q), and found by asking for level 1, 2, ... until one is missing. Single words keep exact counts, as the base score needs.

The model is a table of shards by a hash of word or n-gram: each holds a slice of the words and a filter of its own, made in one task for
about the same amount of text whatever the corpus holds. Documents meet it in blocks: a block asks each shard for its distinct words and n-grams.
A model up to ``Settings.broadcast_bytes`` is broadcast, and answers where the block is; a larger one answers shard by shard, and its
answers are dealt back to the blocks. Both give the same scores.

How far an n-gram is trusted depends on how often its context was seen: for each level of that count, the share of the shorter n-gram in the mixture is
found by deleted interpolation. In each chunk of texts, every other text is scored with the counts of the rest, and the shares that make those texts likeliest are
found from all chunks' histograms of (longer over shorter estimate).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, beside_row, from_row, small_batches, stored, trimmed

#: Two tokens that no text holds, since words have no spaces: before the first word, and after the last one.
BEGIN, END = b" begin", b" end"
#: Multipliers of the hash that extends an n-gram by a word, and of the finalizer of 64-bit hashes.
EXTEND = np.uint64(0x9E3779B97F4A7C15)
FINAL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Settings:
    """``order``: longest n-gram. ``base``: of the levels. ``probes``: hash functions of the filter. Sizes: text for which a shard is made, text of a block or chunk, model that is broadcast."""

    order: int = 2
    base: float = 1.5
    probes: int = 8
    shard_bytes: int = 32 << 20
    block_bytes: int = 12 << 20
    broadcast_bytes: int = 16 << 20


@dataclass(frozen=True)
class Model:
    """``shards``: shard, words, counts, bits. ``tokens`` and ``kinds``: tokens, and different ones, that were counted. ``texts``: how many.

    ``shares``: for n-grams from 2 on, and each level of their context's count (0 for none), the share of the shorter n-gram.
    """

    shards: DataFrame
    n_shards: int
    tokens: int
    kinds: int
    texts: int
    shares: np.ndarray
    settings: Settings = field(default_factory=Settings)


def _mix(x: np.ndarray) -> np.ndarray:
    """The bits of each number spread over all 64, in its own place."""
    for shift, factor in zip((30, 27), FINAL):
        x ^= x >> np.uint64(shift)
        x *= factor
    x ^= x >> np.uint64(31)
    return x


def level_floors(base: float) -> np.ndarray:
    """The least count of each level: 1, then ever more by the power of ``base``, as whole numbers."""
    floors, power = [1], base
    while ceil(power) < 1 << 62:
        if ceil(power) > floors[-1]:
            floors.append(ceil(power))
        power *= base
    return np.array(floors, np.int64)


def level_values(base: float) -> np.ndarray:
    """What level q stands for: 0 for none, else the middle of the counts of that level."""
    floors = level_floors(base)
    return np.concatenate([[0.0], (floors[:-1] + floors[1:] - 1) / 2, floors[-1:]])


def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(keys.astype(np.uint64) + np.uint64(level << 32))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def _place(low: np.ndarray, step: np.ndarray, probe: int, n_bits: int) -> np.ndarray:
    """The bit that a probe looks at, from the two hashes of (key, level)."""
    return (((low + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * np.uint64(n_bits)) >> np.uint64(32)


def make_filter(keys: np.ndarray, counts: np.ndarray, s: Settings) -> bytes:
    """The bits of the filter for distinct keys of 32 bits: so many that about half of them are ones."""
    levels = np.searchsorted(level_floors(s.base), counts, side="right")
    n_bits = min(ceil(int(levels.sum()) * s.probes / log(2) / 8) * 8, (1 << 32) - 8)
    bits = np.zeros(n_bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        low, step = _hashes(keys[levels >= level], level)
        for probe in range(s.probes):
            bits[_place(low, step, probe, n_bits)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def ask_filter(bits: bytes, keys: np.ndarray, s: Settings) -> np.ndarray:
    """The level of each key: one less than the first that isn't in the filter. A key misses a level at its first zero."""
    found, held = np.zeros(len(keys), np.uint8), np.frombuffer(bits, np.uint8)
    asked = np.arange(len(keys) if bits else 0)
    for level in range(1, len(level_floors(s.base)) + 1):
        low, step = _hashes(keys[asked], level)
        for probe in range(s.probes):
            place = _place(low, step, probe, 8 * len(held))
            hit = (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            asked, low, step = asked[hit], low[hit], step[hit]
        if not len(asked):
            break
        found[asked] = level
    return found


def _values(words: pa.LargeStringArray) -> list[bytes]:
    """The bytes of an array's strings, cut from its one buffer."""
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = words.buffers()[2].to_pybytes() if len(words) else b""
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _tokens(texts: list[pa.Array]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word in the order of the texts, the distinct words, words of each text and 2 for its ends)."""
    column = pa.concat_arrays([pa.array([], pa.large_string()), *[t.cast(pa.large_string()) for t in texts]]).fill_null("")
    split = pc.ascii_split_whitespace(pc.ascii_lower(column))  # only A-Z change; words end at spaces and controls 9 to 13
    pieces = split.flatten()
    real = pc.greater(pc.binary_length(pieces), 0)  # text that begins or ends with a space gives an empty piece
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    lengths = np.diff(kept[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]) + 2
    coded = pieces.filter(real).dictionary_encode()
    return coded.indices.to_numpy(), _values(coded.dictionary), lengths


def _places_of(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each value stands in ``among``, which holds all of them in order: by order of size, so that memory is read in order too."""
    order = np.argsort(values)
    found = np.empty(len(values), np.int32)
    found[order] = np.searchsorted(among, values[order])
    return found


class Block:
    """Some texts as tokens: their distinct words and n-grams in order of their shards, and where each stands."""

    def __init__(self, texts: list[pa.Array], n_shards: int, order: int):
        indices, vocabulary, lengths = _tokens(texts)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [BEGIN, END, *vocabulary]), np.uint64, len(vocabulary) + 2)
        self.texts, self.starts = len(lengths), np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.ids = np.zeros(lengths.sum(), np.int32)  # 0 before each text, 1 after it, and its words
        inner = np.ones(len(self.ids), bool)
        inner[self.starts] = inner[self.starts + lengths - 1] = False
        self.ids[self.starts + lengths - 1] = 1
        self.ids[inner] = indices + 2
        del indices, inner
        self.since = np.arange(len(self.ids), dtype=np.int32)  # tokens of its text before it, the beginning among them
        self.since -= np.repeat(self.starts.astype(np.int32), lengths)
        shards = (hashes & np.uint64(n_shards - 1)).astype(np.int64)
        at = np.lexsort((hashes[2:], shards[2:]))
        if (np.diff(hashes[2:][at]) == 0).any():  # two words with one hash: in order of the words, as texts come in any order
            at = np.array(sorted(range(len(vocabulary)), key=lambda i: (shards[i + 2], hashes[i + 2], vocabulary[i])), np.int64)
        self.words, self.word_ids = [vocabulary[i] for i in at.tolist()], at + 2
        self.word_shards = shards[self.word_ids]
        self.ends, self.grams = [], []
        last = one = hashes[self.ids]
        for n in range(2, order + 1):
            at = np.flatnonzero(self.since >= n - 1).astype(np.int32)
            gram = _mix((last[at - 1] + np.uint64(n)) * EXTEND ^ one[at])
            if n < order:
                last = np.zeros_like(one)
                last[at] = gram
            self.ends.append(at)
            self.grams.append((gram & np.uint64(n_shards - 1)) << np.uint64(32) | gram >> np.uint64(32))
        del last, one
        where = np.concatenate([np.zeros(0, np.uint64), *self.grams])
        where.sort()
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])[: len(where)])
        self.gram_counts, where = np.diff(first, append=len(where)).astype(np.int32), where[first]
        self.gram_shards, self.keys = (where >> np.uint64(32)).astype(np.int32), where.astype(np.uint32)

    def by_shard(self) -> Iterator[tuple[int, slice, slice]]:
        """(shard, its words, its n-grams), in order, for shards with any."""
        for shard in np.union1d(self.word_shards, self.gram_shards).tolist():
            yield shard, slice(*np.searchsorted(self.word_shards, [shard, shard + 1])), slice(*np.searchsorted(self.gram_shards, [shard, shard + 1]))

    def where(self) -> np.ndarray:
        """The distinct n-grams, in order."""
        return self.gram_shards.astype(np.uint64) << np.uint64(32) | self.keys

    def halves(self, s: Settings) -> np.ndarray:
        """[n-gram, level of the context, bin of the ratio]: how often, in every other text, the estimate from the other texts is so many times the shorter one's."""
        made = np.zeros((s.order - 1, len(level_floors(s.base)) + 1, len(BINS) + 1), np.int64)
        odd = (np.searchsorted(self.starts, np.arange(len(self.ids)), side="right") & 1).astype(bool)  # of the first text, the third, ...
        word = np.bincount(self.ids[odd], minlength=2).astype(float)
        word = np.pad(word, (0, max(0, int(self.ids.max(initial=0)) + 1 - len(word))))
        count, tokens, kinds = word[self.ids], word[1:].sum(), np.count_nonzero(word[1:])
        chance, shorter, where, value, floors = (count + 0.5) / (tokens + 0.5 * (kinds + 1)), count, self.where(), level_values(s.base), level_floors(s.base)
        for n, (at, gram) in enumerate(zip(self.ends, self.grams)):
            place = _places_of(gram, where)
            levels = np.searchsorted(floors, np.bincount(place[odd[at]], minlength=len(where)), side="right")
            context = shorter[at - 1]
            found = np.minimum(value[levels[place]], np.minimum(context, shorter[at]))
            ratio = np.divide(found, context, out=np.zeros_like(found), where=context > 0) / chance[at]
            asked = ~odd[at]
            np.add.at(made[n], (np.searchsorted(floors, context[asked], side="right"), np.searchsorted(BINS, ratio[asked], side="right")), 1)
            chance[at] *= 0.5 + 0.5 * ratio
            shorter = np.zeros_like(shorter)
            shorter[at] = found
        return made

    def scores(self, word_counts: np.ndarray, levels: np.ndarray, model: Model) -> list[np.ndarray]:
        """For each text: tokens, known ones, base score and the model's log10 probability.

        A word's probability is (count + 1/2) over what they add up to; an n-gram's is mixed of the shorter one's and of count over count of its context.
        Counts from the filter may be too large; none is more than that of its context or of its shorter end.
        """
        of_word = np.zeros(len(word_counts) + 2)
        of_word[:2] = model.texts
        of_word[self.word_ids] = word_counts
        count = of_word[self.ids]
        chance = base = (count + 0.5) / (model.tokens + 0.5 * (model.kinds + 1))
        shorter, value, floors, where = count, level_values(model.settings.base), level_floors(model.settings.base), self.where()
        for shares, at, gram in zip(model.shares, self.ends, self.grams):
            context = shorter[at - 1]
            found = np.minimum(value[levels[_places_of(gram, where)]], np.minimum(context, shorter[at]))
            share = shares[np.searchsorted(floors, context, side="right")]
            chance = chance.copy()
            chance[at] = share * chance[at] + (1 - share) * np.divide(found, context, out=np.zeros_like(found), where=context > 0)
            shorter = np.zeros_like(shorter)
            shorter[at] = found
        real = self.since > 0
        total = lambda x: np.add.reduceat(np.where(real, x, 0), self.starts)
        return [total(np.ones(len(real), np.int64)), total((count > 0).astype(np.int64)), total(np.log10(base)), total(np.log10(chance))]


#: Bounds of the ratios that are counted together: none, then four to a doubling.
BINS = np.concatenate([[2.0**-40], 2.0 ** (np.arange(-64, 161) / 4)])
#: Tokens from which a level of context counts has shares of its own; a level with fewer takes those of the next lower one.
LEAST_SEEN = 1_000


def shares_of(histograms: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The shares of the shorter n-gram that make what was counted likeliest, by expectation and maximization; 1 where the context was never seen."""
    ratio = np.concatenate([[0.0], np.sqrt(BINS[:-1] * BINS[1:]), BINS[-1:]])
    shares = np.full(histograms.shape[:2], 0.5)
    seen = histograms.sum(axis=2)
    for _ in range(rounds):
        part = shares[:, :, None] / (shares[:, :, None] + (1 - shares[:, :, None]) * ratio)
        shares = np.where(seen > 0, (part * histograms).sum(axis=2) / np.maximum(seen, 1), shares)
    shares = np.clip(shares, 0.01, 0.999)
    for n in range(len(shares)):
        for level in range(1, shares.shape[1]):
            if seen[n, level] < LEAST_SEEN:
                shares[n, level] = shares[n, level - 1] if level > 1 else 0.9
    shares[:, 0] = 1
    return shares


def _squeezed(data: bytes) -> bytes:
    """Small for the shuffle: its size, and what zstd makes of it."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _widened(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order as their steps, all first bytes together, then all second ones, ...: the high ones are mostly zero."""
    return _squeezed(np.diff(keys, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked_keys(data: bytes) -> np.ndarray:
    steps = np.frombuffer(_widened(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint32).ravel(), dtype=np.uint32)


def _listed(blob: bytes) -> list[bytes]:
    return blob.split(b"\n") if blob else []


class Shard:
    """One shard of a model, ready to answer."""

    def __init__(self, words: bytes, counts: bytes, bits: bytes):
        self.counts, self.bits = dict(zip(_listed(words), np.frombuffer(counts, np.int64).tolist())), bits

    def answer(self, words: list[bytes], keys: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.counts.get(w, 0) for w in words], np.int64), ask_filter(self.bits, keys, s)


def _power_of_two(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def _chunks(batches: Iterator[pa.RecordBatch], limit: int, text_of=lambda batch: batch.column("text")) -> Iterator[tuple[list[pa.RecordBatch], list[pa.Array]]]:
    """Batches with their texts, in chunks of about ``limit`` bytes of text."""
    held, texts, n = [], [], 0
    for batch in batches:
        held.append(batch)
        texts.append(text_of(batch))
        n += texts[-1].nbytes
        if n >= limit:
            yield held, texts
            held, texts, n = [], [], 0
    if held:
        yield held, texts


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows that are sorted by ``key``, all of a key at once."""
    held, now = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and keys[a] != now:
                yield now, held
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Counts the n-grams of all texts. A null or empty text is just an end; a table without rows gives a model that knows nothing.

    Chunks count what they hold before anything is shuffled, so the most frequent word is one number of each chunk. Counts don't depend on how texts are
    dealt to chunks; the shares of the mixture do a little, as each chunk's halves are held against each other.
    """
    small_batches(docs.sparkSession)
    s, n_shards = settings, _power_of_two(ceil(_text_bytes(docs) / settings.shard_bytes))

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "texts", "halves", "words", "counts", "keys", "key_counts"]
        for _, texts in _chunks(batches, s.block_bytes):
            block = Block(texts, n_shards, s.order)
            counts = np.bincount(block.ids, minlength=len(block.words) + 2)[block.word_ids].astype(np.int32)
            yield pa.RecordBatch.from_pylist([dict(zip(names, (0, block.texts, _squeezed(block.halves(s).tobytes()), *[_squeezed(b"")] * 4)))], _COUNTED)
            for shard, w, k in block.by_shard():
                row = (shard, 0, b"", _squeezed(b"\n".join(block.words[w])), _squeezed(counts[w].tobytes()), _packed_keys(block.keys[k]), _squeezed(block.gram_counts[k].tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(names, row))], _COUNTED)

    @trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _runs(batches, "shard"):
            words, texts, halves, keys, key_counts = Counter(), 0, 0, [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
            for batch in rows:
                for r in batch.to_pylist():
                    texts += r["texts"]
                    halves = halves + np.frombuffer(_widened(r["halves"]), np.int64) if r["halves"] else halves
                    for word, n in zip(_listed(_widened(r["words"])), np.frombuffer(_widened(r["counts"]), np.int32).tolist()):
                        words[word] += n
                    keys.append(_unpacked_keys(r["keys"]))
                    key_counts.append(np.frombuffer(_widened(r["key_counts"]), np.int32))
            distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(of, np.concatenate(key_counts), len(distinct)).astype(np.int64)
            known = sorted(words)
            counts = np.array([words[w] for w in known], np.int64)
            row = {"shard": shard, "texts": texts, "halves": halves.tobytes() if shard == 0 else b"", "tokens": int(counts.sum()), "kinds": len(known), "words": b"\n".join(known), "counts": counts.tobytes(), "bits": make_filter(distinct, totals, s)}
            yield pa.RecordBatch.from_pylist([row], _SHARD)

    counted = docs.select("text").mapInArrow(count, "shard long, texts long, halves binary, words binary, counts binary, keys binary, key_counts binary")
    shards = stored(counted.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard long, texts long, halves binary, tokens long, kinds long, words binary, counts binary, bits binary"))
    texts, tokens, kinds = (n or 0 for n in shards.agg(F.sum("texts"), F.sum("tokens"), F.sum("kinds")).first())
    first = shards.where("shard = 0").select("halves").first()
    shape = (s.order - 1, len(level_floors(s.base)) + 1, len(BINS) + 1)
    halves = np.frombuffer(first["halves"], np.int64).reshape(shape) if first else np.zeros(shape, np.int64)
    return Model(shards.select("shard", "words", "counts", "bits"), n_shards, tokens + texts, kinds + (texts > 0), texts, shares_of(halves), s)


_COUNTED = pa.schema([("shard", pa.int64()), ("texts", pa.int64()), ("halves", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("key_counts", pa.binary())])
_SHARD = pa.schema([("shard", pa.int64()), ("texts", pa.int64()), ("halves", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary()), ("levels", pa.binary())])
_REQUEST = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary())])
LM = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A struct column ``lm`` beside the columns of ``docs``: n_tokens (with the end), n_known, base_score, score, both log10 of probabilities.

    A null text is an empty one, whose only token is its end. Repeated rows are scored each; an empty table gives no rows. A text is scored
    as a whole however long it is, in one block; other columns come through untouched.
    """
    small_batches(docs.sparkSession)
    s, n_shards, told = model.settings, model.n_shards, replace(model, shards=None)
    rows = docs.select(as_row(docs))
    shape = beside_row(rows, "lm", LM)
    lm_type = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def with_scores(row: pa.Array | pa.ChunkedArray, block: Block, counts: list[np.ndarray], levels: list[np.ndarray]) -> pa.Table:
        joined = np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, np.uint8), *levels])
        columns = block.scores(*joined, told)
        return pa.table({"row": row, "lm": pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(lm_type))})

    size = model.shards.agg(F.sum(F.octet_length("words") + F.octet_length("counts") + F.octet_length("bits"))).first()[0] or 0
    if size <= s.broadcast_bytes:
        sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: (bytes(r["words"]), bytes(r["counts"]), bytes(r["bits"])) for r in model.shards.collect()})

        @trimmed
        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nothing = Shard(b"", b"", b"")
            shards = {i: Shard(*of) for i, of in sent.value.items()}
            for held, texts in _chunks(batches, s.block_bytes, lambda batch: batch.column("row").field("text")):
                block = Block(texts, n_shards, s.order)
                found = [shards.get(i, nothing).answer(block.words[w], block.keys[k], s) for i, w, k in block.by_shard()]
                yield from with_scores(pa.Table.from_batches(held).column("row"), block, [f[0] for f in found], [f[1] for f in found]).to_batches()

        return from_row(rows.mapInArrow(scored, shape), docs.columns, "lm")

    n_blocks = max(ceil(_text_bytes(docs) / s.block_bytes), 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).repartition(n_blocks, "block")

    @trimmed
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _runs(batches, "block"):
            block = Block([batch.column("text") for batch in held], n_shards, s.order)
            for shard, w, k in block.by_shard():
                row = {"shard": shard, "block": number, "words": _squeezed(b"\n".join(block.words[w])), "counts": b"", "bits": _packed_keys(block.keys[k])}
                yield pa.RecordBatch.from_pylist([row], _REQUEST)

    @trimmed
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] < 0:
                    now, shard = r["shard"], Shard(r["words"], r["counts"], r["bits"])
                    continue
                if r["shard"] != now:
                    now, shard = r["shard"], Shard(b"", b"", b"")
                counts, levels = shard.answer(_listed(_widened(r["words"])), _unpacked_keys(r["bits"]), s)
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "shard": now, "counts": _squeezed(counts.tobytes()), "levels": _squeezed(levels.tobytes())}], _ANSWER)

    def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block([chunk.field("text") for chunk in texts.column("row").chunks], n_shards, s.order)
        found = {r["shard"]: r for r in answers.to_pylist()}
        asked = [found[i] for i, _, _ in block.by_shard()]
        return with_scores(texts.column("row"), block, [np.frombuffer(_widened(a["counts"]), np.int64) for a in asked], [np.frombuffer(_widened(a["levels"]), np.uint8) for a in asked])

    request_shape = "shard long, block long, words binary, counts binary, bits binary"
    requests = dealt.select("block", F.col("row.text").alias("text")).sortWithinPartitions("block").mapInArrow(ask, request_shape)
    models = model.shards.select("shard", F.lit(-1).cast("long").alias("block"), "words", "counts", "bits")
    met = models.unionByName(requests).repartition(n_shards, "shard").sortWithinPartitions("shard", "block")
    answers = met.mapInArrow(answer, "block long, shard long, counts binary, levels binary")
    return from_row(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, shape), docs.columns, "lm")

