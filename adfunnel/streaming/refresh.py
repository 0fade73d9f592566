"""Continuous refresh of the funnel outputs (T1-T4) with Structured Streaming.

Three kinds of queries share a work folder and talk through its logs only:

* one ingest stream per source folder (explicit schema) adds each micro-batch
  to a stored table, partitioned by batch and month, and then marks the batch
  complete; a replayed batch writes over itself;
* the publisher (``publish.py``), on a timer of its own, merges complete
  batches into the state and publishes snapshots every ``interval_seconds``;
* the insights stream reads the refresh log as its source, on a slower trigger,
  and makes alerts, recommendations and the digest of the newest good snapshot.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DATA_REFRESH_SECONDS, INSIGHTS_REFRESH_SECONDS, FunnelConfig
from ..operators import rules as RL
from . import log as L
from .publish import TABLES, Publisher

log = logging.getLogger(__name__)

__all__ = ["TABLES", "Publisher", "freshness", "latest_insights", "latest_snapshot", "make_insights", "start_ingest", "start_insights", "start_refresh"]


def start_ingest(spark: SparkSession, name: str, source_dir: str, schema, work_dir: str, available_now: bool = False, interval_seconds: int = DATA_REFRESH_SECONDS, files_per_batch: int | None = None) -> StreamingQuery:
    """The stream of one source folder into its stored table."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def sink(batch: DataFrame, batch_id: int) -> None:
        month = F.date_format("date", "yyyy-MM") if "date" in batch.columns else F.lit(None).cast("string")
        stored = f"{work_dir}/stored/{name}/batch_id={batch_id}"
        # a window opens its months only, and of these the row groups with its days
        dealt = batch.withColumn("month", month)
        # every task writes the months of its own split: no shuffle, and no task has all rows of a busy month
        dealt = dealt.sortWithinPartitions("month", "date") if "date" in batch.columns else dealt
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(stored)
        # last: readers go by this mark
        rows = batch.sparkSession.read.schema(batch.schema).parquet(stored).agg(F.count("*").alias("rows"))
        L.write(rows, f"{work_dir}/ingested/{name}/number={batch_id}")

    w = reader.parquet(source_dir).writeStream.foreachBatch(sink).option("checkpointLocation", f"{work_dir}/checkpoints/{name}")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{interval_seconds} seconds")
    return w.queryName(f"adfunnel_ingest_{name}_{L.new_id()}").start()


def make_insights(spark: SparkSession, work_dir: str, snapshot: str, config: FunnelConfig | None = None) -> str:
    """Alerts, recommendations and digest of a snapshot, as tables; its log entry, written last, makes them visible."""
    read = lambda name: spark.read.parquet(f"{snapshot}/{name}")
    tree, kpis = read("performance_tree"), read("kpis")
    path = f"{work_dir}/insights/{L.new_id()}"
    RL.rule_alerts(tree, kpis).write.parquet(f"{path}/rule_alerts")
    RL.recommendations(tree).write.parquet(f"{path}/recommendations")
    RL.digest_lines(tree, kpis, read("top_creatives"), read("bottom_creatives")).write.parquet(f"{path}/digest")
    L.insights_made(spark, work_dir, snapshot, path)
    return path


def start_insights(spark: SparkSession, work_dir: str, available_now: bool = False, interval_seconds: int = INSIGHTS_REFRESH_SECONDS) -> StreamingQuery:
    """A stream over the refresh log; each trigger takes the newest good snapshot that came since."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        newest = batch.where("snapshot is not null and not stale").orderBy(F.col("last_sync").desc()).first()
        if newest is None:
            return
        try:
            make_insights(batch.sparkSession, work_dir, newest.snapshot)
        except Exception as exc:  # the last insights stay; the log goes on, and so the next trigger tries again
            log.error("insights of %s failed: %s", newest.snapshot, exc)

    w = spark.readStream.schema(L.REFRESH).parquet(f"{work_dir}/refresh_log/*").writeStream.foreachBatch(sink)
    w = w.option("checkpointLocation", f"{work_dir}/checkpoints/insights")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{interval_seconds} seconds")
    return w.queryName(f"adfunnel_insights_{L.new_id()}").start()


def start_refresh(
    spark: SparkSession,
    source_dirs: dict[str, str],
    schemas: dict,
    work_dir: str,
    config: FunnelConfig | None = None,
    available_now: bool = False,
    interval_seconds: int = DATA_REFRESH_SECONDS,
    insights_seconds: int = INSIGHTS_REFRESH_SECONDS,
    files_per_batch: int | None = None,
    buckets: int = 64,
) -> list[StreamingQuery]:
    """Start the whole refresh: ingest of each table, publisher and insights.

    ``available_now`` takes what is there, publishes once, makes insights and
    returns when all is done (tests, catch-up runs).
    """
    publisher = Publisher(spark, work_dir, schemas, config, buckets)
    queries = [start_ingest(spark, n, source_dirs[n], schemas[n], work_dir, available_now, interval_seconds, files_per_batch) for n in TABLES]
    if not available_now:
        return [*queries, publisher.start(interval_seconds), start_insights(spark, work_dir, interval_seconds=insights_seconds)]
    for q in queries:
        q.awaitTermination()
    publisher.run("available now")
    insights = start_insights(spark, work_dir, available_now=True)
    insights.awaitTermination()
    return [*queries, insights]


def latest_snapshot(spark: SparkSession, work_dir: str) -> str | None:
    good = L.refreshes(spark, work_dir).where("snapshot is not null and not stale")
    row = good.orderBy(F.col("last_sync").desc(), F.col("snapshot").desc()).select("snapshot").first()
    return row[0] if row else None


def latest_insights(spark: SparkSession, work_dir: str):
    """(generated_at, snapshot, insights) of the newest insights, or None."""
    return L.insights(spark, work_dir).orderBy(F.col("generated_at").desc()).first()


def freshness(spark: SparkSession, work_dir: str, interval_seconds: int = DATA_REFRESH_SECONDS) -> DataFrame:
    """T4: last sync, its age, whether the published data is stale, and whether insights are ready."""
    good = F.when(~F.col("stale"), F.col("last_sync"))
    newest = F.max(F.struct("last_sync", "stale"))
    last = L.refreshes(spark, work_dir).agg(F.max(good).alias("last_sync"), F.count(good).alias("refreshes"), newest.alias("newest"))
    made = L.insights(spark, work_dir).agg(F.max("generated_at").alias("insights_at"))  # one row
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("last_sync")
    return last.crossJoin(made).select(
        "last_sync",
        "refreshes",
        age.alias("age_seconds"),
        (F.col("last_sync").isNotNull()).alias("connected"),
        F.coalesce(F.col("newest.stale") | (age > interval_seconds), F.lit(True)).alias("stale"),
        F.col("insights_at").isNotNull().alias("insights_ready"),
    )
