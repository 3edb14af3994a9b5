"""A watcher of a folder that files which fail do not stop: dead letters with attempts, finished work skipped, an end when idle.

Files come in micro-batches. What is done is one row a file under ``out/done``, what failed is one row a file and attempt under
``out/dead``, in folders named after the files they are about, so work that is done twice replaces its own rows. Files that are done or
dead are left out of later batches, so neither a restart nor a lost checkpoint does work again. Dead ones are tried again in rounds
of their own, up to ``attempts`` times in all; after that they are poison and stay where they are.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

Work = Callable[[DataFrame], DataFrame]
ATTEMPTS = 3


class Watcher:
    """``work`` maps rows of ``path, content`` to rows of ``path, ..`` with a string column ``error`` (null: done)."""

    def __init__(self, spark: SparkSession, folder: str, out: str, work: Work, *, pattern: str = "*", files_per_batch: int = 8, attempts: int = ATTEMPTS):
        self.spark, self.folder, self.out, self.work = spark, folder, out.rstrip("/"), work
        self.pattern, self.files_per_batch, self.attempts = pattern, files_per_batch, attempts

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.out}/{name}")
        except AnalysisException:  # nothing has been written yet
            return None

    def done(self) -> DataFrame | None:
        return self._table("done")

    def dead(self) -> DataFrame | None:
        """``path, attempts, error`` of files that have failed and are not done: how often, and the last error."""
        failed, done = self._table("dead"), self.done()
        if failed is None:
            return None
        rows = failed.groupBy("path").agg(F.count("*").alias("attempts"), F.max_by("error", "attempt").alias("error"))
        return rows if done is None else rows.join(done.select("path"), "path", "left_anti")

    def poison(self) -> DataFrame | None:
        dead = self.dead()
        return None if dead is None else dead.where(F.col("attempts") >= self.attempts)

    def _batch(self, files: DataFrame, number: int) -> None:
        """Work on the files of a micro-batch that are neither done nor dead."""
        for known in (self.done(), self._table("dead")):
            if known is not None:
                files = files.join(known.select("path").distinct(), "path", "left_anti")
        self._run(files, 1)

    def _run(self, files: DataFrame, attempt: int) -> None:
        paths = sorted(r["path"] for r in files.select("path").distinct().collect())  # a micro-batch of files
        good, bad = self._attempt(files, paths)
        name = hashlib.sha256("\n".join([str(attempt), *paths]).encode()).hexdigest()[:32]
        for kind, parts in (("done", good), ("dead", bad)):
            if parts:
                rows = reduce(DataFrame.unionByName, parts).withColumn("attempt", F.lit(attempt))
                rows.write.mode("overwrite").parquet(f"{self.out}/{kind}/batch={name}")

    def _attempt(self, files: DataFrame, paths: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
        if not paths:
            return [], []
        try:
            made = self.work(files.where(F.col("path").isin(paths))).persist()
            made.count()
        except Exception as e:  # any failure of the work is an answer about its files
            if len(paths) == 1:
                return [], [self.spark.createDataFrame([(paths[0], str(e)[:500])], "path string, error string")]
            half = len(paths) // 2
            first, second = self._attempt(files, paths[:half]), self._attempt(files, paths[half:])
            return first[0] + second[0], first[1] + second[1]
        return [made.where("error IS NULL").drop("error")], [made.where("error IS NOT NULL").select("path", F.left("error", F.lit(500)).alias("error"))]

    def _round(self, checkpoint: str) -> StreamingQuery:
        kinds = "path string, modificationTime timestamp, length long, content binary"
        stream = self.spark.readStream.format("binaryFile").schema(kinds).option("pathGlobFilter", self.pattern).option("maxFilesPerTrigger", self.files_per_batch).load(self.folder)
        writer = stream.select("path", "content").writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def retry(self) -> int:
        """Try some dead letters again that are not poison, those of fewest attempts first; how many there were."""
        dead = self.dead()
        if dead is None:
            return 0
        again = dead.where(F.col("attempts") < self.attempts).orderBy("attempts", "path").limit(self.files_per_batch).collect()
        for n in sorted({r["attempts"] for r in again}):
            files = self.spark.read.format("binaryFile").load([r["path"] for r in again if r["attempts"] == n])
            self._run(files.select("path", "content"), n + 1)
        return len(again)

    def run(self, checkpoint: str, *, idle_rounds: int = 3, pause: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> int:
        """Rounds until ``idle_rounds`` in a row brought nothing; how many rounds there were."""
        idle = rounds = 0
        while idle < idle_rounds:
            query = self._round(checkpoint)
            query.awaitTermination()
            new = sum(p["numInputRows"] for p in query.recentProgress)
            idle = 0 if new + self.retry() else idle + 1
            rounds += 1
            if idle < idle_rounds:
                sleep(pause)
        return rounds
