"""Documents to token counts: quality rules, toxicity, near duplicates, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; run() writes each result as
Parquet in the shared folder and reads it back for the next stage.

Rows are told apart by a key of their own, so null ids, ids that stand twice and repeated rows are rows like others. An
empty table stays empty through all stages. Columns beyond those of documents are kept by all stages but the
last, whatever their names. Each stage states what it does with null and empty texts and with ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import jaccard, kit, mixing, queries, repetition, toxicity


def _passing(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], condition: str, new: tuple[str, ...]) -> DataFrame:
    """The rows of docs that decide's result keeps; columns named like its new ones step aside meanwhile."""
    aside = {c: f"_aside_{c}" for c in docs.columns if c.lower() in new}
    decided = decide(docs.withColumnsRenamed(aside)).filter(condition)
    return decided.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; null and empty texts fail for want of words."""
    return _passing(docs, repetition.repetition_rules, "kept", (*repetition.COUNTS, "base_failed", "kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic by a field fitted to the labels of the rows given.

    Null and empty texts have no evidence and stay; so do all where no row of one class is labelled.
    """
    field = toxicity.train(docs, kit.table(spark, sf_dir, "labels"))
    return _passing(docs, lambda df: toxicity.score_toxicity(df, field), "predicted = 0", ("score", "predicted", "spans"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (null last) of each group of near duplicates, repeated rows among them.

    Rows without words, null texts among them, are no one's duplicates and stay. Of rows with one id the first as read stays.
    """
    rows = kit.keyed(docs)
    groups = jaccard.jaccard_components(rows, ident=kit.ROW, row=kit.ROW).select(kit.ROW, "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", kit.ROW)).alias("first")
    kept = groups.join(rows.select(kit.ROW, "doc_id"), kit.ROW).groupBy("component_id").agg(first).select(f"first.{kit.ROW}")
    return rows.join(kept, kit.ROW, "left_semi").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them; the one at a source's budget is cut to its words.

    Rows without words take no part in the mix and go. A null source is a source. Ties of the random key go by id, size and row.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every row; a null text is an empty one."""
    return queries.bpe_digests(docs)


STAGES = [("quality_rules", quality), ("toxicity", clean), ("near_duplicates", distinct), ("mixing", mixed), ("bpe", tokens)]

#: Hashes of texts, a fitted field and BPE have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kit.stage(docs)
    return docs
