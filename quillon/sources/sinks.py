"""Writers: manifests with their statistics, splits, reports, decision logs, fingerprints.

All of them refuse protected folders, as :func:`layout.write_jsonl` does, and write with Spark's own writers, so a report may
be several files of one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.corpora import manifest_stats
from quillon.sources.layout import PROTECTED, write_jsonl


def guard(path: str) -> str:
    """The path, unless it lies in a protected folder."""
    if PROTECTED & set(path.rstrip("/").split("/")):
        raise ValueError(f"{path} lies in a protected folder")
    return path


def write_manifests(rows: DataFrame, path: str, *, corpus: str = "corpus", part: str = "part", xml: str = "xml", mode: str = "errorifexists") -> None:
    """Lists of documents by part (``list/part=train``), all records (``records``), rows per corpus and part (``stats``) and an audit of
    records without an image or text."""
    guard(path)
    rows.select(part, F.col(xml).alias("value")).write.mode(mode).partitionBy(part).text(f"{path}/list")
    write_jsonl(rows, f"{path}/records", mode)
    write_jsonl(manifest_stats(rows, corpus, part), f"{path}/stats", mode)
    audited = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in rows.columns]
    write_jsonl(rows.groupBy(corpus).agg(F.count("*").alias("n"), *audited), f"{path}/audit", mode)


def write_phases(rows: DataFrame, path: str, rules: dict[str, Column], plan: dict[str, tuple[str, str]], xml: str = "xml", mode: str = "errorifexists") -> None:
    """Overlapping lists (``manifest=name``) and the plan of phases, each with its lists."""
    from quillon.operators.records import phases

    guard(path)
    phases(rows, rules).select("manifest", F.col(xml).alias("value")).write.mode(mode).partitionBy("manifest").text(f"{path}/list")
    steps = [(k, base, manifest) for k, (base, manifest) in plan.items()]
    write_jsonl(rows.sparkSession.createDataFrame(steps, "phase string, base string, manifest string"), f"{path}/plan", mode)


def write_split(rows: DataFrame, path: str, value: str, split: str = "split", mode: str = "errorifexists") -> None:
    """Two lists of paths, ``split=train`` and ``split=val``."""
    rows.select(F.col(split).alias("split"), F.col(value).alias("value")).write.mode(mode).partitionBy("split").text(guard(path))


def batch_rows(done: DataFrame, failed: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """One report of a batch: jobs that went well, failed and were skipped, with a ``status``; what a kind lacks is null."""
    marked = [df.withColumn("status", F.lit(s)) for df, s in ((done, "ok"), (failed, "failed"), (skipped, "skipped"))]
    return marked[0].unionByName(marked[1], allowMissingColumns=True).unionByName(marked[2], allowMissingColumns=True)


def append_decisions(rows: DataFrame, path: str) -> None:
    """Adds decisions to a log that is only ever added to."""
    write_jsonl(rows, path, "append")


def latest_decisions(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last decision of every key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def save_fingerprints(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Fingerprints with their vectors as they are, as Parquet."""
    rows.write.mode(mode).parquet(guard(path))


def load_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
