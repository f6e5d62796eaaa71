"""Streaming: job records, event-time alerts, job state with a time to live.

A query's checkpoint holds what has been consumed; a batch that failed runs
again, so sinks are idempotent: a record is keyed by job and revision, and what
is written twice is the same row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.metrics import latest_revision

RECORD = "job_id string, revision int, status string, updated_at timestamp, result string"


def job_stream(spark: SparkSession, path: str, schema: str = RECORD, per_batch: int = 100) -> DataFrame:
    """Job records arriving as JSON files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def upsert(target: str) -> Callable[[DataFrame, int], None]:
    """T4: a foreachBatch sink: each batch has its own partition, so that a repeated one replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.dropDuplicates(["job_id", "revision"]).withColumn("batch", F.lit(batch_id))
        once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return write


def run_jobs(jobs: DataFrame, target: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None):
    """Fast records (revision 1) and, with ``enrich``, those of revision 2; ends when all input is read."""

    def both(batch: DataFrame, batch_id: int) -> None:
        out = batch
        if enrich:
            open_jobs = batch.where(~F.col("status").isin("completed", "completed_with_warnings"))
            out = batch.unionByName(enrich(open_jobs).withColumn("revision", F.lit(2)))
        upsert(target)(out, batch_id)

    return jobs.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_jobs(spark: SparkSession, target: str) -> DataFrame:
    """Each job's latest record."""
    return latest_revision(spark.read.parquet(target).drop("batch"))


def deferred(files: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(large files, whose OCR waits; the others); 0 means none waits."""
    large = (F.col("length") >= threshold) & F.lit(threshold > 0)
    return files.where(large), files.where(~large)


def windowed_rate(attempts: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", least: int = 20, rate: float = 0.2) -> DataFrame:
    """T7 in event time: n, failed, rate and alert of each sliding window; works on streams and tables alike."""
    ts = F.col("ts").cast("timestamp")
    df = attempts.withColumn("ts", ts)
    df = df.withWatermark("ts", late) if df.isStreaming else df
    out = df.groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fallback").cast("long")).alias("failed"))
    share = F.round(F.col("failed") / F.col("n"), 4)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "failed", share.alias("rate"), ((F.col("n") >= least) & (share >= rate)).alias("alert"))


def latest_state(jobs: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """The running latest revision of each job; state is dropped ``ttl_ms`` after its last change."""
    from pyspark.sql.streaming import StatefulProcessor

    class Latest(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", "revision int, status string", ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            best = self.seen.get() if self.seen.exists() else (-1, "")
            for batch in rows:
                for r in batch.itertuples():
                    if r.revision > best[0]:
                        best = (int(r.revision), r.status)
            self.seen.update(best)
            yield pd.DataFrame({"job_id": [key[0]], "revision": [best[0]], "status": [best[1]]})

        def close(self) -> None:
            pass

    return jobs.groupBy("job_id").transformWithStateInPandas(Latest(), "job_id string, revision int, status string", "update", "processingTime")


def with_reloaded_side(side: Callable[[], DataFrame], work: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads the static side anew for every batch."""
    return lambda batch, batch_id: work(batch, side())
