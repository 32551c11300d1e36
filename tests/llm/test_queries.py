"""The registered corpus queries on a small folder of tables, each held against a plain version of its contract."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from tests.llm.test_operators import brute_bytes, brute_components, brute_words, words_of
from weftgraph.llm import decontamination, language_id, queries, toxicity
from weftgraph.llm.common import fold_of

CONVERSATIONS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_start|>"), (1, 2, "assistant", "[INST] no [/INST]"), (1, 4, "assistant", ""), (1, 3, "user", None),
    (2, 0, "user", "one turn"), (3, 1, "assistant", "b\\<|end|>"), (3, 0, "human", "a"), (4, 0, None, None),
]


def documents():
    rng = random.Random(31)
    kinds = {"aa": ["ba", "ke", "lo"], "bb": ["xi", "zu", "qo"]}
    make = lambda lang, n: " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(300):
        lang = rng.choice(list(kinds))
        rows.append((i, make(lang, rng.randint(3, 90)) + (" grumblefoo" if i % 5 == 0 else ""), lang))
    copied = make("aa", 60)
    rows += [(600 + i, f"{make('aa', 8)} {copied} {make('aa', 8)}", "aa") for i in range(6)]
    rows += [(700 + i, copied.upper() if i % 2 else copied, "aa") for i in range(4)]
    return rows + [(400, None, "aa"), (401, "", "bb"), (402, "12 !?", None), (403, "kelo <|endoftext|> é 漢字 </s>  x", "aa"), (404, make("bb", 3000), "bb")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = documents()
    rng = random.Random(32)
    items = [(i, words_of(rng, 12, 500)) for i in range(6)] + [(7, None), (8, "")]
    docs += [(500 + i, f"{words_of(rng, 20, 500)} {items[i][1]} {words_of(rng, 20, 500)}", "aa") for i in range(4)]
    x = np.random.default_rng(33).normal(size=(400, 8)).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, 2.0]), (480, x[0].tolist())]
    made = {
        "documents": (docs, "doc_id long, text string, lang string"),
        "benchmark": (items, "item_id long, text string"),
        "labels": ([(i, int("grumblefoo" in (t or ""))) for i, t, _ in docs if i < 250], "doc_id long, toxic int"),
        "embeddings": (vectors, "vec_id long, embedding array<float>"),
        "conversations": (CONVERSATIONS, "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in made.items():
        frame = spark.createDataFrame(rows, schema).repartition(3)
        frame.withColumns({"source": fold_of(frame.columns[0]), "n_chars": fold_of(frame.columns[0])}).write.parquet(f"{folder}/{name}.parquet")
    return folder, {k: v[0] for k, v in made.items()}


def held_out(i):
    return crc32(str(i).encode()) % 4 == 2


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, tables):
    folder, rows = tables
    got = {r.doc_id: r for r in queries.op1_language_id(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows["documents"]}
    # the model's counts, and the back-off, once more from their definitions
    learned = [(t, lang) for i, t, lang in rows["documents"] if not held_out(i) and t is not None and lang is not None]
    counts = [{} for _ in range(6)]
    for t, lang in learned:
        for w in language_id.WORDS.findall(t.lower()):
            padded = f"<{w}>"
            for g, n in [(w, 0)] + [(padded[k : k + n], n) for n in range(1, 6) for k in range(len(padded) - n + 1)]:
                counts[n].setdefault(g, {"aa": 0, "bb": 0})[lang] += 1
    totals = [{x: sum(c[x] for c in table.values()) for x in ("aa", "bb")} for table in counts]

    def logs(n, g):
        v = np.array([math.log(counts[n][g][x] + 0.5) - math.log(totals[n][x] + 0.5 * len(counts[n])) for x in ("aa", "bb")])
        return v - v.mean()

    def scores(w):
        if w in counts[0] and sum(counts[0][w].values()) > 1:
            return logs(0, w)
        padded = f"<{w}>"
        for n in range(5, 0, -1):
            hits = [logs(n, g) for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) in counts[n]]
            if hits:
                return sum(hits) / len(hits)
        return np.zeros(2)

    for i, t, _ in rows["documents"]:
        words = language_id.WORDS.findall((t or "").lower())
        assert got[i].held_out == held_out(i)
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        z = sum(map(scores, words))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].score == pytest.approx(p.max(), abs=1e-4)
        if abs(z[0] - z[1]) > 1e-3:
            assert got[i].lang_pred == ("aa", "bb")[int(z.argmax())]


def test_op3(spark, tables):
    folder, rows = tables
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows["documents"]}
    for i, t, _ in rows["documents"]:
        assert got[i].held_out == held_out(i) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
    caught = [got[i].predicted == int("grumblefoo" in t) for i, t, _ in rows["documents"] if i < 300 and held_out(i)]
    assert np.mean(caught) > 0.85
    # scores once more from the model's weights: a text is the mean of its words, a word the mean of its n-grams and itself
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(fold_of("doc_id") != 2))
    for i, t, _ in rows["documents"]:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            assert got[i].score == model.prior
            continue
        z = 0.0
        for w in words:
            w = f"<{w}>"
            grams = [w] + [w[k : k + n] for n in (3, 4, 5, 6) for k in range(len(w) - n + 1)]
            z += sum(float(model.weight[crc32(g.encode()) % model.buckets]) for g in grams) / len(grams) / len(words)
        z = model.slope * (z + model.bias) + model.offset
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))), abs=1e-6)


def brute_spans(texts, w):
    """Maximal runs of bytes that earlier strings of ``w`` bytes cover."""
    seen, out = set(), {}
    for i, t in texts:
        b, end, out[i] = t.encode(), -1, 0
        for k in range(len(b) - w + 1):
            if b[k : k + w] in seen:
                out[i] += k > end
                end = k + w
            seen.add(b[k : k + w])
    return out


def test_op2_and_op9(spark, tables):
    folder, rows = tables
    texts = [(i, t or "") for i, t, _ in rows["documents"]]
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, folder).collect()}
    assert {i: (r.n_removed, r.kept_sha256) for i, r in got.items()} == brute_bytes(texts, 100)
    assert all(got[i].n_bytes == len(t.encode()) for i, t in texts)
    assert {i: r.n_spans for i, r in got.items()} == brute_spans(texts, 100)
    got = {r.doc_id: r for r in queries.op9_substring_dedup(spark, folder).collect()}
    assert {i: (r.n_removed, r.kept_sha256) for i, r in got.items()} == brute_words(texts, 50)
    assert all(got[i].n_words == len(t.split()) for i, t in texts)


def test_op4(spark, tables):
    folder, rows = tables
    got = queries.op4_neighbours(spark, folder).collect()
    fine = {i: np.array(v, float) for i, v in rows["embeddings"] if v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    assert {r.query_id for r in got} == {i for i in fine if i % 20 == 0}
    hits = 0
    for q in {r.query_id for r in got}:
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        best = sorted((-float(np.cumsum(fine[q] * v)[-1]), i) for i, v in fine.items() if i != q)[:20]
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(s == pytest.approx(float(fine[q] @ fine[i]), abs=1e-12) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
    assert hits >= 0.9 * 20 * len({r.query_id for r in got})


def test_op5_and_op6(spark, tables):
    import sentencepiece
    from tokenizers import Tokenizer

    folder, rows = tables
    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    counts = {r.doc_id: r for r in queries.op5_token_counts(spark, folder).collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    coded = {r.doc_id: r for r in queries.op6_sentence_pieces(spark, folder).collect()}
    for i, t, _ in rows["documents"]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((t or "").encode()), n, n > 512)
        ids = pieces.encode(t or "", add_eos=True)
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(pieces.decode(ids)))


def test_op7(spark, tables):
    folder, rows = tables
    got = {r.doc_id: r for r in queries.op7_near_dedup(spark, folder).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components([(i, t) for i, t, _ in rows["documents"]])
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_op8(spark, tables):
    folder, rows = tables
    got = {(r.doc_id, r.item_id): r.score for r in queries.op8_decontamination(spark, folder).collect()}

    def best(x, y):
        """Smith-Waterman, cell by cell."""
        before, top = [0] * (len(y) + 1), 0
        for a in x:
            row = [0]
            for j, b in enumerate(y):
                row.append(max(0, before[j] + (2 if a == b else -1), before[j + 1] - 1, row[j] - 1))
            before, top = row, max(top, *row)
        return top

    expected = {}
    for i, t, _ in rows["documents"]:
        for j, x in rows["benchmark"]:
            a, b = decontamination.words(x or ""), decontamination.words(t or "")
            if a and b and len(b) < 400 and (s := best(a, b)) >= len(a):
                expected[i, j] = s
    assert got == expected and set(expected) == {(500 + i, i) for i in range(4)}


def test_op10(spark, tables):
    folder, _ = tables
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, folder).collect()}
    said = "</s>[INST] ok [/INST]"
    all_rows = CONVERSATIONS + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert set(got) == {r[0] for r in all_rows}
    for c, row in got.items():
        mine = sorted((r for r in all_rows if r[0] == c), key=lambda r: r[1])
        turns = [(r or "", t or "") for _, _, r, t in mine]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))


def test_empty_tables(spark, tables, tmp_path):
    folder, rows = tables
    for name in rows:
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (name == "op10_chat_format")
