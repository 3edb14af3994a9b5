"""Shared helpers of the training-data operators: tables, the shared scratch folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans import registry

_own_scratch: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path. A small one of few files is dealt out to all cores."""
    return registry.table(spark, sf_dir, name)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` where it is set; otherwise one temporary folder for this process, with a
    local master only: on a cluster, executors do not see each other's folders.
    """
    global _own_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="quillon-")
    return f"file://{_own_scratch}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the files, not a recomputation, and a
    frame that several branches use is computed once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stash` that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if "/quillon/" in path.toString():
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` under a name that says what the call sites mean."""
    return df.mapInArrow(fn, schema)


#: Bits of the filter below: 65,536 longs, whatever the number of ids.
FILTER_BITS = 22


def maybe_among(ids: DataFrame, column: Column) -> Column:
    """True for every value of ``column`` that is in the one column of ``ids``, and for few others.

    A bitmap of fixed size, made by a scalar subquery of the plan it stands in (as a literal, its megabyte of text would
    be in every description of that plan). It spares rows that a join would drop anyway the shuffle; the join itself
    still decides. With far more ids than bits it only stops helping.
    """
    name = ids.columns[0]
    spot = F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))
    low = F.lit(63).cast("long")
    marks = ids.select(
        F.shiftright(spot, 6).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(low).cast("int")).alias("bit"),
    )
    every = ids.sparkSession.range(1 << (FILTER_BITS - 6)).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = marks.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    placed = F.sort_array(F.collect_list(F.struct("word", "bits")))
    held = words.agg(F.transform(placed, lambda x: x["bits"]).alias("bits")).scalar()
    at = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    return F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(low).cast("int")) == 1
