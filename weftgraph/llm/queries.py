"""The registered queries of the corpus operators: each applies its operator to its whole table.

Each returns the columns that its contract names; digests are derived from the operator's own outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat_format as chat
from weftgraph.llm import decontamination, fill_middle
from weftgraph.llm import language_id as lid
from weftgraph.llm import lm_scores, near_dedup, neighbours, part_codes
from weftgraph.llm import sentence_pieces as sp
from weftgraph.llm import substring_dedup, suffix_dedup
from weftgraph.llm import token_counts as tok
from weftgraph.llm import toxicity as tox
from weftgraph.llm.common import fold_of, table

TOXIC_FROM = 0.3
TOKEN_LIMIT = 512
#: Folder of the public tokenizer files; None takes the installed package's.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lid.fit(docs.where(fold_of("doc_id") != 2))
    named = lid.language_id(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (fold_of("doc_id") == 2).alias("held_out"), "language.lang_pred", "language.score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text", "rest")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text", "rest")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = tox.fit(docs, table(spark, sf_dir, "labels").where(fold_of("doc_id") != 2))
    scored = tox.toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold_of("doc_id") == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tok.token_counts(docs, tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def piece_digests(docs: DataFrame) -> DataFrame:
    coded = sp.sentence_pieces(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.col("pieces.n_ids").alias("n_tokens"),
        F.sha2(F.col("pieces.ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("pieces.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_rows(rows))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return part_codes.compress(vectors, part_codes.fit(vectors)).drop("label")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of("doc_id", 5) == 1).alias("held_out"))
    model = lm_scores.fit(docs.where("NOT held_out"))
    scored = lm_scores.score(docs, model)
    return scored.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("fim.output"), F.col("fim.form"))
    digests = [F.sha2(text.cast("binary"), 256).alias(name) for text, name in ((F.col("fim.output"), "output_sha256"), (back, "restored_sha256"))]
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_neighbours": op4_neighbours,
    "op5_token_counts": op5_token_counts,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_near_dedup": op7_near_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_vector_codes": op11_vector_codes,
    "op12_lm_scores": op12_lm_scores,
    "op13_fill_middle": op13_fill_middle,
}


def _code_sql(parts: int = 16, entries: int = 64, scale: int = 256, rounds: int = 2) -> str:
    """Assignment by a join of the components with those of all entries, round by round."""
    steps = [f"""kept AS (
  SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
cells AS (SELECT vec_id, unnest(e) AS x, unnest(generate_series(0, len(e) - 1)) AS i, len(e) // {parts} AS w FROM kept),
pieces AS (SELECT vec_id, i // w AS part, i % w AS d, x FROM cells),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
book0 AS (SELECT part, entry, d, x FROM pieces JOIN seeds USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS (SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS far FROM pieces p JOIN book{r} b ON p.part = b.part AND p.d = b.d GROUP BY ALL),
near{r} AS (SELECT vec_id, part, entry, far FROM far{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (SELECT p.part, n.entry, p.d, CAST(sum(p.x) AS BIGINT) AS total, count(*) AS n FROM pieces p JOIN near{r} n ON p.vec_id = n.vec_id AND p.part = n.part GROUP BY ALL),
book{r + 1} AS (SELECT b.part, b.entry, b.d, CASE WHEN m.n IS NULL THEN b.x ELSE (m.total - ((m.total % m.n) + m.n) % m.n) // m.n END AS x FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry AND b.d = m.d)""")
    coded = f"""coded AS (SELECT k.vec_id, k.label, string_agg(format('{{:02x}}', n.entry), '' ORDER BY n.part) AS code, CAST(sum(n.far) AS BIGINT) AS error FROM kept k JOIN near{rounds} n USING (vec_id) GROUP BY ALL),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, d)) AS codebooks_sha256 FROM book{rounds})"""
    return "WITH " + ",\n".join([*steps, coded]) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


FIM_SQL = """WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d FROM drawn),
forms AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
made AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM forms)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM made"""

#: SQL can't express the other operators; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _code_sql(), "op13_fill_middle": FIM_SQL}
