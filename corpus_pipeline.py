"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of ``documents``; the last returns the packed pieces. ``run``
writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import kneser, minhash, packing, secrets, toxicity
from matchlake.llm.common import small, small_batches, table, written
from matchlake.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest labelled examples vote toxic go; a row's text alone decides.

    Null and empty texts score the base rate; other columns are passed on; no rows give none.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    score = toxicity.scorer(toxicity.fit(docs, labels), spark)
    return docs.where(score(F.col("text").cast("string")) < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows over the perplexity limit of their language go.

    Rows that repeat a doc_id go together if their texts are equal. Other columns, whatever
    their names, are passed on; no rows give none.
    """
    found = kneser.classify(docs, table(spark, sf_dir, "labels"))
    poor = written(found.where(~F.col("kept")).select("row_key", "doc_id").distinct(), "poor")
    poor = small(poor.select(F.col("row_key").alias("poor_key"), F.col("doc_id").alias("poor_id")), 32).alias("__poor")
    # The key is a hash; the id beside it keeps rows of other documents apart.
    same = (kneser.row_key() == F.col("__poor.poor_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__poor.poor_id"))
    return docs.join(poor, same, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates stays.

    Of rows that repeat a doc_id one stays, the one whose text comes first. Rows
    without doc_id stay.
    """
    found = written(minhash.near_duplicates(docs).select("doc_id", "kept"), "kept")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_id"))
    gone, again = small(written(gone, "gone"), 24).alias("__gone"), small(written(again, "again"), 24).alias("__again")
    doc_id = F.col("doc_id").cast("long")
    left = docs.join(gone, doc_id == F.col("__gone.gone_id"), "left_anti")
    once = left.join(again, doc_id == F.col("__again.again_id"), "left_anti")
    first = left.join(again, doc_id == F.col("__again.again_id"), "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("row"))
    return once.unionByName(first.select("doc_id", "row.*").select(*docs.columns))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by its kind in brackets; n_chars follows the text.

    A null text stays null, with a null n_chars; all rows and other columns stay.
    """
    small_batches(spark)
    text = secrets.clean(F.col("text").cast("string"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences; a null text is empty, no rows give none."""
    return packing.pack(docs, TOKENIZER, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: Trained votes and perplexities are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
