"""The corpus operators on small tables: by brute force, by round trip, and on nulls, empty and repeated rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat_format, decontamination, language_id, near_dedup, neighbours, repeats, sentence_pieces, substring_dedup, suffix_dedup, token_counts, toxicity
from weftgraph.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=DOCS):
    rows = [(i, t, None, None, None) for i, t in texts] if isinstance(texts, list) else texts
    return spark.createDataFrame(rows, schema)


def odd(spark):
    """Null, empty and repeated rows, and columns that the operators use inside."""
    texts = [(None, "a b c"), (1, None), (2, ""), (3, "   "), (4, "one two three"), (4, "one two three"), (5, "one two three"), (6, "1234 !!"), (7, "x" * 3000)]
    return docs_of(spark, texts).withColumns({c: F.lit("clash") for c in ("key", "rest", "doc", "n", "k", "t", "id", "a", "anchor", "language", "toxicity", "pieces", "component_id", "kept")})


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1


def test_language(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ba", "ke", "lo"], "bb": ["xi", "zu", "qo"]}
    make = lambda lang, n: " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 30), lang, None, None) for i in range(40) for lang in kinds]
    model = language_id.fit(docs_of(spark, tuple(rows)))
    unseen = docs_of(spark, tuple((i, make(lang, 5), lang, None, None) for i in range(20) for lang in kinds))
    got = language_id.language_id(unseen, model).select("lang", "language.*").collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)


def test_language_backs_off_to_shorter_grams():
    zero = np.zeros(2)
    model = language_id.LanguageModel(["a", "b"], {"known": np.array([1.0, -1])}, [{"z": np.array([-1.0, 1])}, {"<k": np.array([2.0, -2])}])
    assert model.vector("known")[0] == 1 and model.vector("kz")[0] == 2 and model.vector("z")[0] == -1
    assert (model.vector("y") == zero).all()


def test_language_of_odd_rows(spark):
    d = odd(spark)
    for model in (language_id.LanguageModel(), language_id.LanguageModel(["a"], {}, [])):
        got = {r.doc_id: r.language for r in language_id.language_id(d, model).collect()}
        assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == "und" and got[1].score == 0
    assert language_id.fit(d.limit(0)).langs == []
    assert language_id.language_id(d.limit(0), model).count() == 0


# 3


def test_toxicity(spark):
    rng = random.Random(2)
    texts = [(words_of(rng, 60) + (" grumblefoo" if i % 4 == 0 else "") + " " + words_of(rng, 60), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.train([t for t, _ in texts], [y for _, y in texts], buckets=1 << 16)
    d = docs_of(spark, [(1, words_of(rng, 80) + " grumblefoe " + words_of(rng, 80)), (2, words_of(rng, 160)), (3, None), (4, "")])
    got = {r.doc_id: r.toxicity for r in toxicity.toxicity(d, model).collect()}
    assert got[1] > 0.5 > 0.3 > got[2] and got[3] == got[4] == pytest.approx(0.25)


def test_toxicity_without_labels(spark):
    d = odd(spark)
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxicity for r in toxicity.toxicity(d, model).collect()} == {0.0}


# 4


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:400] = x[7]  # many equal vectors
    got = neighbours.nearest(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, k=10).collect()
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        s = x.astype(float) @ x[q].astype(float)
        for r in mine:
            assert r.score == pytest.approx(s[r.vec_id], abs=1e-9)
        keys = [(-round(r.score, 9), r.vec_id) for r in mine]
        assert keys == sorted(keys) and q not in {r.vec_id for r in mine}
        best = np.lexsort((np.arange(600), -np.round(s, 9)))
        hits += len({r.vec_id for r in mine} & set(best[best != q][:10].tolist()))
    assert hits >= 0.9 * 300


def test_neighbours_in_slices_and_parts(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[100:700] = x[3]  # most rows are one vector, as are most queries
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    whole, dealt = (
        sorted(map(tuple, neighbours.nearest(rows, F.col("vec_id") % 3 == 0, k=7, **small).collect())) for small in ({}, {"slice_rows": 20, "part_queries": 9})
    )
    assert whole == dealt and len(whole) == 7 * 300
    few = sorted(map(tuple, neighbours.nearest(rows.where("vec_id < 5"), F.lit(True), k=7).collect()))
    assert len(few) == 5 * 4 and neighbours.nearest(rows, F.lit(False)).count() == 0


def test_a_query_meets_the_rows_of_its_own_leaves_only():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(120, 24))
    x = (centres[rng.integers(0, 120, 12_000)] + 0.1 * rng.normal(size=(12_000, 24))).astype(np.float32)
    forest = neighbours.Forest(x[:6_000], len(x), 4, 80)
    wanted = forest.fit_visits(len(x), 600, 20, 0.95)
    at, met, hits = forest.leaves(x), [], 0
    for i in range(0, len(x), 200):
        q = x[i].astype(float)
        leaves, floor = forest.ask(q, wanted, 20)
        own = np.isin(at, leaves).any(axis=1)
        s = x.astype(float) @ q
        s[i] = -np.inf
        assert np.count_nonzero(s[own] >= floor) >= 20 and len(leaves) >= wanted
        met.append(own.mean())
        hits += np.count_nonzero(own[np.argsort(-s)[:20]])
    assert np.mean(met) < 0.2 and hits >= 0.9 * 20 * len(met)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = neighbours.nearest(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 7, 1.0)]
    assert neighbours.nearest(vectors(spark, []), F.col("vec_id") == 0).count() == 0


# 5


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "'", "'s", "'re", "'ll", "1", "23", "é", "漢字", "🙂", "!", "--", "\t", " ", "<|endoftext|>", "\x1c", "²", "_", "ing", "tion", "'LL"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + ["", "a" * 500, " " * 300, "!" * 300, "ab " * 400]
    machine = token_counts.TokenCounter(open(path, encoding="utf-8").read())
    library = Tokenizer.from_file(path)
    assert machine.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tokens_that_fit_are_told_without_merging_them_anew(monkeypatch):
    machine = token_counts.TokenCounter(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()).transducer
    rng, tokens = random.Random(7), list(machine.text)
    pairs = [tuple(rng.choices(tokens, k=2)) for _ in range(3000)]
    pairs += [(machine.tokens[t[:i]], machine.tokens[t[i:]]) for t in list(machine.tokens)[::7] for i in range(1, len(t)) if t[:i] in machine.tokens and t[i:] in machine.tokens]
    fit = [machine.merged([machine.tokens[bytes([x])] for x in machine.text[a] + machine.text[b]]) == [a, b] for a, b in pairs]
    assert 0 < sum(fit) < len(fit)
    merged, longest = machine.merged, []
    monkeypatch.setattr(machine, "merged", lambda ids, *more: longest.append(tuple(ids)) or merged(ids, *more))
    assert [machine.compatible[pair] for pair in pairs] == fit
    assert {b"".join(machine.text[i] for i in ids) for ids in longest} <= machine.tokens.keys()


def test_chunk_maps_compose():
    s = np.random.default_rng(5).integers(0, 9, 5000).astype(np.uint8)
    state, marks = 0, []
    for i, x in enumerate(s):
        if token_counts.BEGINS[x, state]:
            marks.append(i)
        state = token_counts.NEXT[x, state]
    assert token_counts.word_starts(s).tolist() == marks


def test_token_counts_of_odd_rows(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd(spark), tokenizer_file("byte_bpe_50k.json")).collect()}
    assert got[1] == got[2] == (0, 0) and got[3] == (3, 3)


# 6


def test_pieces_equal_the_library():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "é", "漢字", "🙂", "!", "▁", "</s>", "<s>", "\x00", "ing", "tion", "Ω", "　", "   x"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + ["", " ", "a" * 300, " " * 50]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = sentence_pieces.Encoder(open(path, "rb").read())
    ids = library.encode(texts, add_eos=True)
    mine = [encoder.encode(t) for t in texts]
    assert mine == [" ".join(map(str, x)) for x in ids]
    assert [encoder.decode(x) for x in mine] == [library.decode(x) for x in ids]
    some = [[rng.randrange(3, 400) for _ in range(12)] for _ in range(200)]
    assert [encoder.decode(" ".join(map(str, x))) for x in some] == [library.decode(x) for x in some]


def test_pieces_that_fit_are_told_without_merging_them_anew(monkeypatch):
    encoder = sentence_pieces.Encoder(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    rng, pieces = random.Random(7), list(encoder.ids)
    pairs = [tuple(rng.choices(pieces, k=2)) for _ in range(3000)]
    pairs += [(p[:i], p[i:]) for p in pieces[::7] for i in range(1, len(p)) if p[:i] in encoder.ids and p[i:] in encoder.ids]
    fit = [encoder.merge(a + b) == [a, b] for a, b in pairs]
    assert 0 < sum(fit) < len(fit)
    merge, merged = encoder.merge, []
    monkeypatch.setattr(encoder, "merge", lambda text, *more: merged.append(text) or merge(text, *more))
    assert [encoder.fits[pair] for pair in pairs] == fit
    assert set(merged) <= set(pieces)


# 2 and 9


def brute_bytes(texts, w):
    seen, out = set(), {}
    for i, t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - w + 1):
            if b[k : k + w] in seen:
                gone[k : k + w] = True
            seen.add(b[k : k + w])
        out[i] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def brute_words(texts, w):
    seen, out = set(), {}
    for i, t in texts:
        x = t.encode().split()
        gone, new = [False] * len(x), set()
        for k in range(len(x) - w + 1):
            key = tuple(x[k : k + w])
            if key in seen:
                gone[k : k + w] = [True] * w
            new.add(key)
        seen |= new
        kept = b" ".join(y for y, g in zip(x, gone, strict=True) if not g)
        out[i] = (sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def repeated_texts():
    rng = random.Random(7)
    line = words_of(rng, 70)
    texts = []
    for i in range(120):
        a, b = words_of(rng, rng.randint(0, 60)), words_of(rng, rng.randint(0, 60))
        texts.append((i, rng.choice([a, f"{a} {line} {b}", f"{line[: rng.randint(50, 400)]} {b}", f"{a} {line} {line}", "é" * rng.randint(0, 300), "ab" * rng.randint(0, 200)])))
    return texts + [(i + 200, rng.choice(texts)[1]) for i in range(30)]


@pytest.mark.parametrize("hot", [4000, 5])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = repeated_texts()
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect()}
    assert got == brute_bytes(texts, suffix_dedup.WINDOW)


@pytest.mark.parametrize("hot", [4000, 5])
def test_substring_dedup_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = repeated_texts()
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs_of(spark, texts)).collect()}
    assert got == brute_words(texts, substring_dedup.WINDOW)


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    rng = random.Random(8)
    s = np.array([rng.randrange(4) for _ in range(3000)], np.uint8)
    w = repeats.Windows(100, 32, None, True)
    seen = [0] * (len(s) - 99)
    for group in repeats._pieces([s], 100):
        ends = np.cumsum([len(p) for _, _, p in group])
        found = w.segments(np.concatenate([p for _, _, p in group]), ends)
        for first, last in zip(found["first"], found["last"], strict=True):
            at = int(np.searchsorted(ends, first, side="right"))
            move = group[at][1] - (ends[at] - len(group[at][2]))
            for p in range(first + move, last + move + 1):
                seen[p] += 1
    assert seen == [1] * len(seen)


def test_anchors_of_much_text_take_little_memory():
    import tracemalloc

    from weftgraph.llm import common

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000).tolist())) for _ in range(150)]
    w = repeats.Windows(100, 32, suffix_dedup._bytes, True)
    common.per_worker("an earlier stage's model", lambda: "kept")
    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int64()), pa.array(texts)], names=["key", "text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in repeats._anchors(w, iter([batch]))) > 3_000_000 / 200
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
    assert not common._MADE


def test_previous_factors():
    rng = random.Random(9)
    segments = [bytes(rng.choices(b"ab", k=rng.randint(1, 60))) for _ in range(12)]
    s = np.frombuffer(b"".join(segments), np.uint8)
    left = np.concatenate([np.arange(len(x), 0, -1) for x in segments])
    got = suffix_dedup.previous_factors(s, left)
    for i in range(len(s)):
        longest = 0
        for j in range(i):
            n = 0
            while n < min(left[i], left[j]) and s[i + n] == s[j + n]:
                n += 1
            longest = max(longest, n)
        assert got[i] == longest


def test_wavelet_matrix():
    x = np.random.default_rng(10).integers(0, 37, 1000)
    m = substring_dedup.WaveletMatrix(x, 37)
    for c in (0, 5, 36):
        places = np.arange(0, 1001, 7)
        symbol = np.full(len(places), c)
        assert (m.track(places, symbol) - m.track(np.zeros(len(places), np.int64), symbol)).tolist() == [int((x[:p] == c).sum()) for p in places]


def test_dedup_of_odd_rows(spark):
    d = odd(spark)
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(d).collect()]
    assert len(got) == 9 and (7, 3000, 2999) in got and (1, 0, 0) in got and (None, 5, 0) in got
    assert substring_dedup.substring_dedup(d).count() == 9
    assert suffix_dedup.suffix_dedup(d.limit(0)).count() == substring_dedup.substring_dedup(d.limit(0)).count() == 0


# 7


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_dedup_by_brute_force(spark):
    rng = random.Random(11)
    texts = [(i, words_of(rng, rng.randint(0, 80), 5000)) for i in range(60)]
    base = words_of(rng, 120, 5000).split()
    for i in range(60, 160):
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = f"edit{rng.randrange(10**6)}"
        texts.append((i, " ".join(x).upper() if i % 2 else " ".join(x)))
    texts += [(200, "same few"), (201, "Same few"), (202, None), (203, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("held,streamed", [(4096, 16384), (7, 5)])
def test_near_dedup_tells_a_family_apart(spark, monkeypatch, held, streamed):
    """Texts that are all near each other, many by less than the threshold: whole buckets are compared, in cells of any size."""
    monkeypatch.setattr(near_dedup, "HELD", held)
    monkeypatch.setattr(near_dedup, "STREAMED", streamed)
    rng = random.Random(22)
    base = words_of(rng, 100, 5000).split()
    texts = []
    for i in range(150):
        x = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            x[rng.randrange(len(x))] = f"edit{rng.randrange(10**6)}"
        texts.append((i, " ".join(x)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()}
    expected = brute_components(texts)
    assert got == expected and 10 < len({c for _, c in expected.values()}) < 140


def test_near_dedup_of_odd_rows(spark):
    rows = near_dedup.near_dedup(odd(spark)).collect()
    got = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert len(rows) == 9 and (None, None, True) in got and (5, 4, False) in got and (2, 2, True) in got and (3, 3, True) in got
    assert near_dedup.near_dedup(odd(spark).limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(12)
    a, b = (rng.integers(0, 2**63, 900).astype(np.uint64) for _ in range(2))
    b[:800] = a[:800]
    r = near_dedup.registers([np.unique(a), np.unique(b), np.union1d(a, b)])
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    one = near_dedup.estimate(r[:1], r[1:2], np.array([900]), np.array([900]))
    assert abs(one[0] - 0.8) < 0.12


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (52, 51)], "a long, b long")
    got = {r.doc: r.component for r in near_dedup.connected_components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 52: 50}


def test_what_a_long_document_asks_for_is_sent_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 2000)
    monkeypatch.setattr(repeats, "PLACE_BITS", 11, raising=False)
    sizes, segments = [], repeats.Windows.segments
    monkeypatch.setattr(repeats.Windows, "segments", lambda self, s, ends: sizes.append(len(s)) or segments(self, s, ends))
    rng = random.Random(21)
    text = "".join(rng.choices("abcdefgh", k=30_000))
    w = repeats.Windows(50, 16, lambda t: np.frombuffer(t.encode(), np.uint8), True)
    asked = [{"kind": repeats.HOT_ASK, "anchor": 1, "a": a, "e": a + 25} for a in range(0, 29_900, 100)]
    batch = pa.RecordBatch.from_pylist([{"key": 3, "text": text, "asked": asked}])
    got = [(r["a"], r["anchor"]) for b in repeats._fetch(w, iter([batch])) for r in b.to_pylist() if r["kind"] == repeats.SEGMENT]
    one = repeats.Windows(50, 50, w.symbols, True)
    places = [p for x in asked for p in range(x["a"], x["e"] + 1)]
    expected = [(p, int(segments(one, w.symbols(text[p : p + 50]), np.array([50]))["anchor"][0])) for p in places]
    assert sorted(got) == sorted(expected) and max(sizes) <= 2000


# 8


def test_decontamination(spark):
    rng = random.Random(13)
    items = [(i, words_of(rng, 40, 3000)) for i in range(20)] + [(90, None), (91, "too short"), (None, "a b c d e")]
    edited = items[3][1].split()
    for k in (4, 15, 26, 33):
        edited[k] = "changed"
    del edited[20]
    texts = [(1, words_of(rng, 100) + " " + items[0][1].upper() + " " + words_of(rng, 50)), (2, " ".join(edited)), (3, words_of(rng, 300)), (4, None), (5, ""), (6, " ".join(items[5][1].split()[:6]) + " " + words_of(rng, 60))]
    texts += [(i, items[7][1]) for i in range(100, 140)]  # leaked often
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 0), (2, 3)} | {(i, 7) for i in range(100, 140)}
    assert got[1, 0] == 1 and 0.7 < got[2, 3] < 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(odd(spark), empty).count() == 0
    assert decontamination.contaminated(odd(spark).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_of_an_item_that_many_documents_share_in_part(spark):
    rng = random.Random(17)
    long, short = words_of(rng, 40, 3000).split(), words_of(rng, 15, 3000).split()
    edit = lambda i: " ".join("changed" if k in (i % 5, 14 - i % 3) else x for k, x in enumerate(short))
    texts = [(i, " ".join(long)) for i in range(3)] + [(i, " ".join(long[:21])) for i in range(100, 500)] + [(i, edit(i)) for i in range(1000, 1400)]
    items = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(spark, texts), items).collect()}
    assert got == {(i, int(i >= 1000)) for i, _ in texts}


def test_decontamination_finds_whatever_alignment_covers(spark, monkeypatch):
    rng = random.Random(18)
    monkeypatch.setattr(decontamination, "BLOCK", 500)
    monkeypatch.setattr(decontamination, "PIECE", 50)
    items = [(i, words_of(rng, n, 60)) for i, n in enumerate([1, 2, 3, 4, 5, 9, 14, 20, 37, 60])]
    spaced = items[8][1].split()
    texts = [(0, " ".join(x if k % 4 else "changed" for k, x in enumerate(spaced))), (1, " and ".join(spaced)), (2, words_of(rng, 900, 60))]
    for i in range(10, 60):
        copy = [x for x in rng.choice(items)[1].split() if rng.random() < 0.9]
        copy = [y for x in copy for y in rng.choice([[x], [x], [x], [f"w{rng.randrange(60)}"], [x, "more"]])]
        texts.append((i, words_of(rng, rng.randrange(150), 60) + " " + " ".join(copy) + " " + words_of(rng, rng.randrange(150), 60)))
    expected = {}
    for i, t in texts:
        for j, x in items:
            h, g = (decontamination.hashes(decontamination.words(y)) for y in (x, t))
            score = int(decontamination.align([h], [g])[0])
            if score >= len(h):
                expected[i, j] = score
    assert (0, 8) in expected and (1, 8) in expected
    rows = decontamination.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in rows} == expected


def test_decontamination_searches_long_documents_in_pieces(monkeypatch):
    rng = random.Random(20)
    monkeypatch.setattr(decontamination, "PIECE", 50)
    monkeypatch.setattr(decontamination, "CELLS", 100)
    items = [(i, words_of(rng, 20, 3000)) for i in range(9)]
    texts = [" ".join(words_of(rng, rng.randrange(60), 3000) + " " + rng.choice(items)[1] for _ in range(20)) for _ in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["doc", "text"])
    rows = [r for b in decontamination._found(decontamination.Index(items, 0.5), iter([batch])) for r in b.to_pylist()]
    assert {(r["doc"], r["item"]) for r in rows if r["coverage"] == 1} == {(i, j) for i, t in enumerate(texts) for j, x in items if x in t}


def test_alignment():
    item, passage = np.arange(10, 20, dtype=np.uint64) * 4, np.arange(0, 40, dtype=np.uint64) * 4
    gapped = np.delete(passage, 15)
    assert decontamination.align([item, item, item], [passage, gapped, passage[:12]]).tolist() == [20, 17, 4]


# 10


def test_chat_escapes_are_reversible():
    rng = random.Random(14)
    parts = [*chat_format.CONTROL, "<", "|", "\\", "turn", "[\\INST]", "</", "s>", "\n", "x"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 10)))
        assert chat_format.unescape(chat_format.escape(t)) == t
        assert not any(c in chat_format.escape(t) for c in chat_format.CONTROL)
        assert chat_format.read_turns(chat_format.format_turn(t, t)[0] * 2) == [(t, t)] * 2


def test_chat_layouts(spark):
    records = [
        ('{"prompt": "p", "response": "r"}', [("user", "p"), ("assistant", "r")]),
        ('{"id": 3, "instruction": "i", "input": "x", "output": "o"}', [("user", "i\nx"), ("assistant", "o")]),
        ('{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "</s>"}]}', [("system", "s"), ("user", "</s>")]),
        ('{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', [("user", "h"), ("assistant", "g")]),
        ('{"unknown": 1}', None),
        ("not json", None),
        (None, None),
    ]
    d = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "i int, record string")
    for row in chat_format.format_records(d).collect():
        expected = records[row.i][1]
        assert (row.chat.formatted is None) == (expected is None)
        if expected:
            assert chat_format.read_turns(row.chat.formatted) == expected
            said = [chat_format.unescape(row.chat.formatted[s.start : s.end]) for s in row.chat.loss]
            assert said == [t for r, t in expected if r == "assistant"]


def test_chat_rows(spark):
    rows = [(1, 2, "assistant", "b<|end|>"), (1, 1, "user", "a"), (1, 3, "assistant", None), (None, 1, "user", "n"), (2, None, None, ""), (1, 2, "assistant", "b<|end|>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_rows(d)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {1, 2, None} and got[1].n_turns == 4 and got[2].n_turns == 1
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb<|end|>\nassistant\nb<|end|>\nassistant\n\n")
    assert got[1].loss_sha256 == sha("b<|end|>b<|end|>") and got[1].loss_chars == 16
    assert chat_format.digests(chat_format.format_rows(d.limit(0))).count() == 0


def test_chat_rows_of_very_long_texts(spark):
    long = "a<|end|>\\ [INST] é漢 " * 40_000
    d = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    turns = chat_format.format_rows(d)
    [got] = chat_format.digests(turns).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got.n_turns, got.turns_sha256) == (3, sha(f"user\n{long}\nassistant\n{long}\nassistant\nb\n"))
    assert (got.loss_chars, got.loss_sha256) == (len(long) + 1, sha(long + "b"))
    assert got.formatted_chars == sum(len(r.formatted) for r in turns.collect())


# columns of other names, and very long texts


CLASH = ("id", "v", "rep", "leaf", "block", "slice", "rank", "score", "query", "width", "doc", "item", "coverage", "kept", "rest", "band", "n", "pieces", "toxicity", "language", "n_tokens")


def test_clashing_columns_with_real_data(spark):
    rng = np.random.default_rng(41)
    x = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)).astype(np.float32))]
    plain = vectors(spark, x)
    clash = plain.withColumns({c: F.lit("clash") for c in CLASH})
    both = [sorted(map(tuple, neighbours.nearest(d, F.col("vec_id") % 20 == 0, k=3).collect())) for d in (plain, clash)]
    assert both[0] == both[1] and len(both[0]) == 9
    r = random.Random(42)
    items = [(i, words_of(r, 15, 900)) for i in range(4)]
    docs = docs_of(spark, [(i, f"{words_of(r, 30, 900)} {items[i][1]} {words_of(r, 30, 900)}") for i in range(4)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    clashing = [d.withColumns({c: F.lit("clash") for c in CLASH}) for d in (docs, bench)]
    assert {(y.doc_id, y.item_id) for y in decontamination.contaminated(*clashing).collect()} == {(i, i) for i in range(4)}


def test_very_long_texts(spark):
    r = random.Random(43)
    long = words_of(r, 150_000, 3000)
    docs = docs_of(spark, [(1, long), (2, long), (3, "x" * 300_000)])
    model = language_id.LanguageModel(["a", "b"], {"w1": np.array([1.0, -1])}, [{"w": np.array([0.5, -0.5])}])
    assert {y.doc_id: y.language.lang_pred for y in language_id.language_id(docs, model).collect()}[1] == "a"
    bag = toxicity.ToxicityModel(1 << 10, np.ones(1 << 10, np.float32), prior=0.5)
    assert all(y.toxicity == pytest.approx(1 / (1 + np.exp(-1))) for y in toxicity.toxicity(docs, bag).collect())
    counted = token_counts.token_counts(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    assert len({y.n_tokens for y in counted if y.doc_id < 3}) == 1 and all(y.n_tokens > 1000 for y in counted)
    coded = sentence_pieces.sentence_pieces(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert {y.doc_id: y.pieces.decoded for y in coded} == {y.doc_id: y.text for y in docs.collect()}
    found = near_dedup.near_dedup(docs).collect()
    assert {(y.doc_id, y.component_id) for y in found} == {(1, 1), (2, 1), (3, 3)}
    cut = {y.doc_id: y for y in suffix_dedup.suffix_dedup(docs).collect()}
    assert cut[1].n_removed == 0 and cut[2].n_removed == cut[2].n_bytes and cut[3].n_removed == 299_999
    assert {y.doc_id: y.n_removed for y in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 150_000, 3: 0}
    item = spark.createDataFrame([(7, " ".join(long.split()[70_000:70_030]))], "item_id long, text string")
    assert {y.doc_id for y in decontamination.contaminated(docs, item).where("coverage = 1").collect()} == {1, 2}
