"""A document pipeline of five stages over the ``documents`` table.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; its result is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.

In every stage: a null text is worked on as an empty one and stays null where it is kept; very long texts are worked on whole; rows without an
id and repeated rows are rows like any other, except that a stage that keeps one of several takes those without an id last; further
columns are carried along, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, line_dedup, packing, simhash, toxicity
from quillon.llm._common import stash, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity models, learnt from ``labels``, reject (score of 0.5 or more). Texts without letters are
    scored too; without labels of both classes nothing is rejected; repeated rows go or stay together."""
    score = toxicity.train_scorer(docs, table(spark, sf_dir, "labels"))
    return docs.where(F.coalesce(score(F.col("text")), F.lit(0.0)) < 0.5)


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts, all but the first of each class; every document stays, with ``n_chars`` counted again
    where lines went."""
    cut = line_dedup.dedup_lines(docs, min_exact=line_dedup.MIN_EXACT)
    length = F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8), that of the smallest id (none comes
    last) and text hash."""
    marked = docs.withColumn("__quillon_hash", F.xxhash64("text"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__quillon_hash").alias("hash"))
    groups = simhash.near_copy_groups(marked.select(own.alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.*").distinct()
    first = stash(first.select(F.col("id").alias("__quillon_id"), F.col("hash").alias("__quillon_first")), "kept-ids")
    same = F.col("doc_id").eqNullSafe(F.col("__quillon_id")) & (F.col("__quillon_hash") == F.col("__quillon_first"))
    kept = marked.join(first.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "__quillon_hash"])
    return kept.select(*docs.columns)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the benchmark contaminates: by their own text, so rows that share an id do not share a verdict. Texts
    without words stay, and so does everything if the benchmark is empty."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 tokens; one row per piece. An empty text is the end id alone; a text longer than a window is cut;
    repeated rows are packed one by one."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", repeated_lines_out),
    ("simhash", near_copies_out),
    ("decontamination", benchmark_out),
    ("packing", pack),
]

#: Language models, edit joins and a tokenizer are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
