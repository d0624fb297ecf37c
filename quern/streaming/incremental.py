"""Compile and crawl status as streams over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import crawl
from quern.plans.compile import Call, Report, State, compile_corpus

RAW = "rel string, content string"
LOG = "domain string, seq bigint, ts timestamp, outcome string, code int"


def compile_stream(spark: SparkSession, arriving: str, corpus: str, state: State, call: Call, checkpoint: str, **options) -> list[Report]:
    """Take in all raw pages (Parquet of ``rel, content``) that arrived since the last run, then compile; returns the batches' reports.

    New pages replace pages of the same path in ``corpus``, a folder of Parquet versions; of several of one path in a batch the one in the file
    written last counts (of files of one moment, the last by name; of rows of one file, the greatest content). Without new files there is no batch, and
    no model call. A batch that is run again after a failure finds what it had finished in the state.
    """
    reports: list[Report] = []

    def take(batch: DataFrame, number: int) -> None:
        pages = State(spark, corpus)
        v = pages.version()
        have = spark.read.schema(RAW).parquet(f"{corpus}/v={v}/raw") if v is not None else spark.createDataFrame([], RAW)
        last = batch.groupBy("rel").agg(F.max_by("content", F.struct("at", "file", "content")).alias("content"))
        merged = have.join(last.select("rel"), "rel", "left_anti").unionByName(last)
        new = f"{corpus}/v={number}/raw"
        if v != number:
            merged.write.mode("overwrite").parquet(new)
            pages.complete(number)
        reports.append(compile_corpus(spark.read.schema(RAW).parquet(new), state, call, **options))

    stream = spark.readStream.schema(RAW).parquet(arriving).select("rel", "content", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return reports


def latest_status(status: DataFrame, batch: DataFrame) -> DataFrame:
    """Block status by domain, the last crawl of a domain wins; ``batch`` is one crawl's log."""
    new = crawl.block_status(batch.withColumn("domain", F.col("domain")))
    return status.join(new.select("domain"), "domain", "left_anti").unionByName(new)


def failures_by_window(log: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """An extension: failures and successes per domain in event-time windows of a running crawl, with a watermark for late rows."""
    return log.withWatermark("ts", late).groupBy("domain", F.window("ts", window)).agg(F.count_if(F.col("outcome") == "success").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("code") == 429).alias("limited"))
