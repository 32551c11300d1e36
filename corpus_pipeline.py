"""The corpus pipeline: five operators of ``weftgraph.llm`` over ``documents``, each stage written and read again.

Stages take (spark, docs, sf_dir). All but the last return the columns of their docs. Rows with a null id
have no place in a dedup's order: such a stage leaves them as they are. ``run`` has a result for empty tables too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, language_id, near_dedup, suffix_dedup
from weftgraph.llm.common import fold_of, stored, table
from weftgraph.llm.queries import piece_digests

#: A text whose language is less certain than this is rejected, as are texts without a letter.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    model = language_id.fit(docs.where(fold_of("doc_id") != 2))
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), language_id.predictor(docs, model)(docs["text"]).alias("found"))
    sure = (F.col("found.lang_pred") != language_id.UNDETERMINED) & (F.col("found.score") >= LEAST_SCORE)
    return named.where(sure).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    copies = near_dedup.near_dedup(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one, or an earlier place, holds too."""
    cut = suffix_dedup.suffix_dedup(docs)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars")).alias("n_chars")
    return cut.select(*[made.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor an edited copy of one."""
    leaks = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number and digests of each document's ids, and the digest of their decoded text."""
    return piece_digests(docs)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_copies),
    ("suffix-array deduplication", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece coding", encode_pieces),
]

#: SQL expresses none of the stages in full; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
