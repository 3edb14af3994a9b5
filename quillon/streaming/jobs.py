"""State per job on a stream of pages: a job is aggregated again when enough of its pages have come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

FIRST, EVERY = 5, 10
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Marks of what cannot be read, tags, and words of a page (fixed values).
UNREAD, TAG, WORD = r"(?i)\[(?:illegible|unclear|gap|omitted)[^\]]*\]", "<[^>]+>", "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def spoken(text: Column) -> Column:
    """A page without tags and marks of what cannot be read."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), UNREAD, " "), TAG, " ")


def due(pages: int, last: int, first: int = FIRST, every: int = EVERY) -> bool:
    """Whether a job of ``pages`` pages is aggregated again after it was at ``last`` (0: never)."""
    return pages >= first and (last == 0 or pages - last >= every)


class PageCounter(StatefulProcessor):
    """Per job: pages and words so far, pages at the last run, number of runs. Rows are counted as they come, none is kept."""

    def __init__(self, first: int, every: int):
        self.first, self.every = first, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "pages long, words long, last long, runs long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the library)
        pages, words, last, runs = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        for batch in rows:
            pages += len(batch)
            words += int(batch["n_words"].sum())
        if due(pages, last, self.first, self.every):
            last, runs = pages, runs + 1
            yield pd.DataFrame({"job": [key[0]], "n_pages": [pages], "n_words": [words], "run": [runs]})
        self.state.update((pages, words, last, runs))

    def close(self) -> None:
        pass


def due_jobs(pages: DataFrame, job: str = "job", text: str = "text", first: int = FIRST, every: int = EVERY) -> DataFrame:
    """``job, n_pages, n_words, run`` of the jobs of a stream that are due after a batch; pages that are empty after cleaning do not count.

    Only a job and a number of words go to its state, so a job that most pages belong to costs a count.
    """
    cleaned = spoken(F.col(text))
    counted = pages.select(F.col(job).alias("job"), F.regexp_count(cleaned, F.lit(WORD)).cast("long").alias("n_words"), F.length(F.trim(cleaned)).alias("n"))
    grouped = counted.where("n > 0").select("job", "n_words").groupBy("job")
    kind = pages.schema[job].dataType.simpleString()
    return grouped.transformWithStateInPandas(PageCounter(first, every), f"job {kind}, n_pages long, n_words long, run long", "Append", "None")


def watch_jobs(
    spark: SparkSession, path: str, schema, aggregate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, job: str = "job", text: str = "text",
    first: int = FIRST, every: int = EVERY, files_per_batch: int = 8,
) -> StreamingQuery:
    """Watch a folder of Parquet pages; jobs that are due are aggregated from all their pages (no others are read again) into ``out/job=..``.

    ``aggregate`` maps the pages of any jobs to rows with the job's column. A restart goes on from the checkpoint; a batch that is
    done twice replaces the same results.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def handle(found: DataFrame, batch_id: int) -> None:
        found = found.persist()
        if not found.isEmpty():
            held = spark.read.schema(schema).parquet(path)
            own = held.join(found.select(F.col("job").alias("_due")).distinct(), F.col(job).eqNullSafe(F.col("_due")), "left_semi")
            made = aggregate(own).join(found.select(F.col("job").alias(job), "n_pages", "n_words", "run"), job)
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(out)
        found.unpersist()

    writer = due_jobs(stream, job, text, first, every).writeStream.outputMode("append").foreachBatch(handle)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
