"""Vector codes, language-model scores and fill-in-middle, each against a plain version of its contract, and on odd rows."""

import hashlib
import math
import random
from collections import Counter
from dataclasses import replace
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import fill_middle, lm_scores, part_codes, queries
from weftgraph.llm.common import fold_of


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        frame = spark.createDataFrame(rows, schema)
        frame.repartition(3).withColumns({c: F.lit(1) for c in ("source", "n_chars", "part", "row", "block", "shard")}).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ---- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][2]) // parts
    piece = lambda v, p: v[p * w : (p + 1) * w]
    books = [[piece(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (far(piece(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, _, v in kept:
                got.setdefault(near(p, v), []).append(piece(v, p))
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e])] if e in got else b for e, b in enumerate(books[p])]
    out = {}
    for i, label, v in kept:
        code = [near(p, v) for p in range(parts)]
        out[i] = ("".join(f"{c:02x}" for c in code), sum(far(piece(v, p), books[p][c]) for p, c in enumerate(code)), label)
    by_label = Counter()
    for _, error, label in out.values():
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, by_label[label], digest) for i, (c, e, label) in out.items()}


def vectors(n=300, width=32):
    x = np.random.default_rng(5).normal(size=(n, width)).round(1)  # rounded: equal parts and ties
    rows = [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)]
    rows += [(n + i, x[0].tolist(), 1) for i in range(40)]
    bad = [None, [float("nan")] * width, [None] + [0.0] * (width - 1), [float("inf")] + [0.0] * (width - 1)]
    return rows + [(900 + i, v, 1) for i, v in enumerate(bad)]


def test_op11(spark, tmp_path):
    folder = written(spark, tmp_path, embeddings=(vectors(), "vec_id long, embedding array<float>, label int"))
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in vectors()]
    got = queries.op11_vector_codes(spark, folder).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == brute_codes(rows)
    assert len(got) == 340


def test_trie_finds_what_comparing_finds():
    rng = np.random.default_rng(6)
    for n, d, k, top in ((1, 1, 1, 3), (3000, 3, 7, 4), (5000, 4, 64, 40), (6000, 2, 5, 2000), (10, 0, 3, 2)):
        parts, book = rng.integers(-top, top, (n, d)), rng.integers(-top, top, (k, d))
        leaves, copies, place = part_codes.distinct_parts(parts)
        assert (leaves[place] == parts).all() and copies.sum() == n
        code, least = part_codes.nearest_entries(leaves, book)
        far = ((leaves[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 2)]):
        frame = spark.createDataFrame(rows, schema)
        assert part_codes.compress(frame, part_codes.fit(frame)).collect() == []
    few = spark.createDataFrame([(1, [0.5] * 20, None), (1, [0.5] * 20, None), (None, [1e30] * 20, 3), (2, [1.0] * 3, 3)], schema)
    got = part_codes.compress(few, part_codes.fit(few)).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == [(0, "02" * 16, 0, 0), (1, "00" * 16, 0, 0), (1, "00" * 16, 0, 0)]


# ---- language-model scores


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    def text():
        at = rng.randrange(200)
        out = []
        for _ in range(rng.randint(1, 80)):
            out.append(words[at])
            at = (at * 7 + rng.choice((0, 0, 0, 1, 5))) % 200
        return " ".join(out)
    rows = [(i, text()) for i in range(500)]
    return rows + [(600, None), (601, ""), (602, "W1 w1\tw2\x0bw3 w4 KX"), (603, "unseen words"), (604, "w1 " * 30_000), (None, "w1 w2")] + [(700, rows[3][1])] * 3


def test_op12(spark, tmp_path):
    folder = written(spark, tmp_path, documents=(texts(), "doc_id long, text string"))
    got = queries.op12_lm_scores(spark, folder).collect()
    cut = lambda t: [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\x0b", " ").split(" ") if w] + [None]
    held = lambda i: i is not None and crc32(str(i).encode()) % 5 == 1
    ones, twos = Counter(), Counter()
    for i, t in texts():
        if not held(i):
            ones.update(cut(t))
            twos.update(zip([b" begin", *cut(t)], cut(t)))
    n, v, starts = sum(ones.values()), len(ones), ones[None]
    value, floors = lm_scores.level_values(1.5), lm_scores.level_floors(1.5)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", (fold_of("doc_id", 5) == 1).alias("held_out"))
    shares = lm_scores.fit(docs.where("NOT held_out")).shares[0]
    close = 0
    rows = {(r.doc_id, r.n_tokens): r for r in got}
    for i, t in texts():
        tokens = cut(t)
        r = rows[i, len(tokens)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(ones[w] > 0 for w in tokens), n)
        one = lambda w: (ones[w] + 0.5) / (n + 0.5 * (v + 1))
        assert r.base_score == pytest.approx(sum(math.log10(one(w)) for w in tokens))
        exact = 0.0
        for a, b in zip([b" begin", *tokens], tokens):
            context = starts if a == b" begin" else ones[a]
            c = min(value[np.searchsorted(floors, twos[a, b], side="right")], context, ones[b])
            share = shares[np.searchsorted(floors, context, side="right")]
            exact += math.log10(share * one(b) + (1 - share) * (c / context if context else 0))
        close += abs(r.score - exact) < 1e-6 * len(tokens)
        assert r.score == pytest.approx(exact, abs=3 + 0.02 * len(tokens)) and r.score < 0
    assert close > 0.7 * len(texts()) and len(got) == len(texts())  # the filter's errors are few
    held_rows = [r for r in got if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows) + 500  # a better model than single words


def test_a_large_model_is_dealt_and_scores_the_same(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(4)
    small = replace(lm_scores.Settings(order=3), shard_bytes=20_000, block_bytes=30_000)
    model = lm_scores.fit(docs.where("doc_id < 300"), small)
    assert model.n_shards > 1 and model.shards.count() == model.n_shards
    together = lm_scores.score(docs, model)
    dealt = lm_scores.score(docs, replace(model, settings=replace(small, broadcast_bytes=-1)))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan
    shown = lambda df: sorted((r.doc_id or -1, r.lm.n_tokens, r.lm.n_known, round(r.lm.base_score, 6), round(r.lm.score, 6)) for r in df.collect())
    assert shown(together) == shown(dealt) and len(shown(dealt)) == len(texts())


def test_shares_are_the_likeliest():
    s, rng = lm_scores.Settings(), np.random.default_rng(2)
    ratio = np.concatenate([[0.0], np.sqrt(lm_scores.BINS[:-1] * lm_scores.BINS[1:]), lm_scores.BINS[-1:]])
    made = np.zeros((1, len(lm_scores.level_floors(s.base)) + 1, len(ratio)), np.int64)
    for level, zeros in ((3, 9_000), (8, 4_000), (9, 500)):
        np.add.at(made[0, level], np.searchsorted(lm_scores.BINS, rng.lognormal(3, 1, 2_000 if level < 9 else 100), side="right"), 1)
        made[0, level, 0] = zeros
    shares = lm_scores.shares_of(made)[0]
    for level in (3, 8):
        like = [(made[0, level] * np.log(x + (1 - x) * ratio)).sum() for x in (shares[level], shares[level] - 0.01, shares[level] + 0.01)]
        assert like[0] == max(like)
    assert shares[0] == 1 and (shares[9:] == shares[8]).all() and (shares[4:8] == shares[3]).all() and shares[1] == shares[2] == 0.9


def test_halves_of_a_block():
    import pyarrow as pa

    block = lm_scores.Block([pa.array(["a b a b", "a b c", "x", None])], 1, 2)
    # texts 1 and 3 count: a 2, b 2, x 1, end 2, beginning 2; ab 2, ba 1. Of texts 2 and 4: (begin, a), (a, b), (b, c), (c, end), (begin, end)
    made, floors = block.halves(lm_scores.Settings())[0], lm_scores.level_floors(1.5)
    level = lambda n: int(np.searchsorted(floors, n, side="right"))
    one = lambda c: (c + 0.5) / (7 + 0.5 * 5)
    expected = np.zeros_like(made)
    for context, found, single in ((2, 1, 2), (2, 2, 2), (2, 0, 0), (0, 0, 2), (2, 0, 2)):
        expected[level(context), np.searchsorted(lm_scores.BINS, (found / context if context else 0) / one(single), side="right")] += 1
    assert (made == expected).all()


def test_filter_levels():
    s = lm_scores.Settings()
    keys = np.unique(np.random.default_rng(9).integers(0, 1 << 32, 50_000, dtype=np.uint64)).astype(np.uint32)
    counts = np.random.default_rng(10).zipf(1.6, len(keys)).clip(1, 10**9)
    seen, unseen = slice(0, len(keys), 2), slice(1, len(keys), 2)
    bits = lm_scores.make_filter(keys[seen], counts[seen], s)
    levels, found = np.searchsorted(lm_scores.level_floors(s.base), counts[seen], side="right"), lm_scores.ask_filter(bits, keys[seen], s)
    assert (found >= levels).all() and (found > levels).mean() < 0.01
    assert (lm_scores.ask_filter(bits, keys[unseen], s) > 0).mean() < 0.01
    assert not lm_scores.ask_filter(b"", keys, s).any() and lm_scores.make_filter(keys[:0], counts[:0], s) == b""
    value = lm_scores.level_values(1.5)
    assert value[:4].tolist() == [0, 1, 2, 3] and (np.diff(value) > 0).all()


def test_scores_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b", 7), (2, None, 8)], "doc_id long, text string, lm int")
    model = lm_scores.fit(none)
    assert lm_scores.score(none, model).collect() == []
    for settings in (model.settings, replace(model.settings, broadcast_bytes=-1)):
        rows = lm_scores.score(some, replace(model, settings=settings)).orderBy("doc_id").collect()
        assert [(r.lm.n_tokens, r.lm.n_known, r.lm.base_score, r.lm.score) for r in rows] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


# ---- fill-in-middle


def brute_fim(i, t):
    t = t or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return (n, "plain", None, None, digest(t), digest(t))
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, digest(f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"), digest(t))
    return (n, "psm", a, b - a, digest(f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"), digest(t))


def test_op13(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    letters = "ab \n\r\té漢🙂́\x00<>PSM "
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "x <S> y"), (503, "<P"), (None, "no key"), (505, "é🙂\n" * 200_000), (506, "a"), (506, "a"), (507, "<P>")]
    folder = written(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = queries.op13_fill_middle(spark, folder).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256))) for r in got)
    assert mine == sorted((-1 if i is None else i, *map(str, brute_fim(i, t))) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert queries.op13_fill_middle(spark, written(spark, tmp_path / "none", documents=([], "doc_id long, text string"))).collect() == []


def test_cuts_of_pieces_are_those_of_whole_texts(monkeypatch):
    whole = [fill_middle.cut_at("é🙂b" * k, a, b) for k in (0, 1, 5, 33) for a in range(0, 101, 7) for b in (0, 3, 99, 100)]
    monkeypatch.setattr(fill_middle, "PIECE", 4)
    assert whole == [fill_middle.cut_at("é🙂b" * k, a, b) for k in (0, 1, 5, 33) for a in range(0, 101, 7) for b in (0, 3, 99, 100)]


def test_extra_columns_and_other_markers(spark):
    form = fill_middle.Form(prefix="[p]", suffix="[s].", middle="(m", plain_percent=0, spm_percent=50)
    rows = [(i, "some text with <P> and more", "x", i) for i in range(50)]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, draws int"), form=form)
    assert made.columns == ["doc_id", "text", "a.b", "draws", "fim"]
    back = made.select("text", "fim.form", fill_middle.restored(F.col("fim.output"), F.col("fim.form"), form).alias("back")).collect()
    assert all(r.text == r.back for r in back) and {r.form for r in back} == {"psm", "spm"}


def test_folds(spark):
    ids = [0, 7, -3, 123456789, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold_of("doc_id", 5).alias("f"), fold_of("doc_id").alias("g")).collect()
    assert [(r.f, r.g) for r in got] == [(0, 0) if i is None else (crc32(str(i).encode()) % 5, crc32(str(i).encode()) % 4) for i in ids]
