"""Small logs of the refresh: a folder per entry, written once, so no two writers share one."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

REFRESH = "last_sync timestamp, snapshot string, source string, stale boolean"
INSIGHTS = "generated_at timestamp, snapshot string, insights string"


def new_id() -> str:
    return f"{dt.datetime.now(dt.timezone.utc).strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:6]}"


def write(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All complete entries of a log."""
    if not path_exists(spark, f"{folder}/*/part-*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/*")


def last(spark: SparkSession, folder: str, schema: str, by: str):
    return read(spark, folder, schema).orderBy(F.col(by).desc()).first()


def last_number(spark: SparkSession, folder: str, after: int = -1) -> int:
    """The largest entry ``number=n`` of a log, ``after`` if there is none beyond it; older entries are not opened."""
    if not path_exists(spark, f"{folder}/number=*/part-*"):
        return after
    entries = spark.read.schema("rows long, number long").parquet(folder)
    return entries.where(F.col("number") > after).agg(F.coalesce(F.max("number"), F.lit(after))).first()[0]


def refreshed(spark: SparkSession, work_dir: str, snapshot: str | None, source: str, stale: bool, entry: str | None = None) -> None:
    row = spark.range(1).select(F.current_timestamp().alias("last_sync"), F.lit(snapshot).cast("string").alias("snapshot"), F.lit(source).alias("source"), F.lit(stale).alias("stale"))
    write(row, f"{work_dir}/refresh_log/{entry or new_id()}")


def refreshes(spark: SparkSession, work_dir: str) -> DataFrame:
    return read(spark, f"{work_dir}/refresh_log", REFRESH)


def insights_made(spark: SparkSession, work_dir: str, snapshot: str, insights: str) -> None:
    row = spark.range(1).select(F.current_timestamp().alias("generated_at"), F.lit(snapshot).alias("snapshot"), F.lit(insights).alias("insights"))
    write(row, f"{work_dir}/insights_log/{new_id()}")


def insights(spark: SparkSession, work_dir: str) -> DataFrame:
    return read(spark, f"{work_dir}/insights_log", INSIGHTS)
