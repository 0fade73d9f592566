"""Rankings, sorting and chart series.

Top-k uses ``orderBy(...).limit(k)`` (TakeOrderedAndProject: each task keeps
its own k best, the driver merges k x tasks rows).  Positions are numbered
after the limit, over at most k rows.  Whole-table orderings are global
range-partitioned sorts; the sort keys are returned as columns so the order
is part of the data.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHART_BAND_FLOOR, CHART_BANDS, CHART_METRICS, DEFAULT_MISSING_SCORE, RANKING_SIZE, SORTABLE_COLUMNS
from ..session import checkpoint_dir

_FIRST = ["first_campaign_key", "first_adset_key", "first_creative_key"]


def _numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    # The input is already limited to a handful of rows.
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_creatives(flat: DataFrame, n: int = RANKING_SIZE) -> DataFrame:
    """Best n consolidated creatives, ties in first-appearance order."""
    order = [F.col("performance_score").desc()] + [F.col(c).asc() for c in _FIRST]
    return _numbered(flat.where(F.col("depth") == 0).orderBy(*order).limit(n), order)


def bottom_creatives(flat: DataFrame, n: int = RANKING_SIZE) -> DataFrame:
    """R2: worst n, worst first; ties in reverse first-appearance order."""
    order = [F.col("performance_score").asc()] + [F.col(c).desc() for c in _FIRST]
    return _numbered(flat.where(F.col("depth") == 0).orderBy(*order).limit(n), order)


def _sort_value(column: str) -> Column:
    if column not in SORTABLE_COLUMNS:
        raise ValueError(f"not a sortable column: {column}")
    if column == "name":
        return F.lower(F.col("name"))
    return F.col(column).cast("double")


def with_position(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place in ``order``, from 1, without a task that sees all.

    Rows are dealt by ranges of the order and sorted in their task; a place is
    that in the task plus the rows of the tasks before, of which the driver
    adds up one count a task.  The dealt rows are a stored table, as another
    sampling of the ranges would deal them otherwise.
    """
    spark = rows.sparkSession
    at = "_at" + "_" * max(len(c) for c in rows.columns)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    path = f"{checkpoint_dir(spark)}/position-{uuid.uuid4().hex[:12]}"
    dealt.write.parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftright(F.col(at), 33)
    counts = sorted(tuple(r) for r in stored.groupBy(part.alias("part")).agg(F.min(at), F.count("*")).collect())
    before = accumulate((n for _, _, n in counts), initial=1)
    shift = [(p, b - first) for (p, first, _), b in zip(counts, before, strict=False)]
    shifts = spark.createDataFrame(shift, f"{at}p long, {at}s long")  # a row per task
    return stored.join(F.broadcast(shifts), part == F.col(f"{at}p")).select(*rows.columns, (F.col(at) + F.col(f"{at}s")).alias(name))


def tree_sorted(tree: DataFrame, column: str = "spend", descending: bool = True) -> DataFrame:
    """R3 as a sorted table; see ``tree_order``."""
    rows, order = tree_order(tree, column, descending)
    return rows.orderBy(*order)


def tree_order(tree: DataFrame, column: str = "spend", descending: bool = True) -> tuple[DataFrame, list[Column]]:
    """Siblings sorted at every level by ``column`` (missing values sort as
    -infinity), each parent followed by its children.

    Each row carries the sort value of its campaign, ad set and itself
    (``sort0..2``); ordering by (sort0, key0, sort1, key1, sort2, key2) is
    the display order.  Ties keep the tree (key) order.
    """
    v = _sort_value(column)
    rows = tree.select("*", v.alias("_v"))
    camp = rows.where(F.col("level") == "campaign").select(F.col("campaign_key").alias("_c"), F.col("_v").alias("sort0"))
    adset = rows.where(F.col("level") == "adset").select(
        F.col("campaign_key").alias("_c2"), F.col("adset_key").alias("_a2"), F.col("_v").alias("_va")
    )
    j = rows.join(camp, rows["campaign_key"] == camp["_c"], "left").join(
        adset, (rows["campaign_key"] == adset["_c2"]) & (rows["adset_key"] == adset["_a2"]), "left"
    )
    lvl = F.col("level")
    out = j.select(
        *tree.columns,
        "sort0",
        F.when(lvl == "adset", F.col("_v")).when(lvl == "creative", F.col("_va")).alias("sort1"),
        F.when(lvl == "creative", F.col("_v")).alias("sort2"),
    )

    def key(c: str) -> Column:
        return F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first()

    # A parent (null child key) precedes its children.
    order = [
        key("sort0"), F.col("campaign_key").asc(),
        F.col("adset_key").isNotNull().asc(), key("sort1"), F.col("adset_key").asc(),
        F.col("creative_key").isNotNull().asc(), key("sort2"), F.col("creative_key").asc(),
    ]
    return out, order


def flat_sorted(flat: DataFrame, column: str = "spend", descending: bool = True) -> DataFrame:
    """R4 as a sorted table; see ``flat_order``."""
    rows, order = flat_order(flat, column, descending)
    return rows.orderBy(*order)


def flat_order(flat: DataFrame, column: str = "spend", descending: bool = True) -> tuple[DataFrame, list[Column]]:
    """Rows of one consolidated level and their global order (missing -> 0)."""
    if column == "name":
        v = F.lower(F.col("name"))
    else:
        v = F.coalesce(_sort_value(column), F.lit(0.0))
    rows = flat.where(F.col("depth") == 0).select("*", v.alias("sort_value"))
    first = [F.col(c).asc() for c in _FIRST]
    return rows, [F.col("sort_value").desc() if descending else F.col("sort_value").asc(), *first]


def campaign_names(tree: DataFrame) -> DataFrame:
    """Sorted distinct campaign display names."""
    return tree.where(F.col("level") == "campaign").select("name").distinct().orderBy("name")


def chart_series(tree: DataFrame, metric: str = "cpl") -> DataFrame:
    """One bar per campaign: value of ``metric`` and a colour class by score."""
    if metric not in CHART_METRICS:
        raise ValueError(f"not a chart metric: {metric}")
    s = F.coalesce(F.col("performance_score"), F.lit(DEFAULT_MISSING_SCORE))
    colour = None
    for lowest, name in CHART_BANDS:
        colour = F.when(s >= lowest, F.lit(name)) if colour is None else colour.when(s >= lowest, F.lit(name))
    colour = colour.otherwise(F.lit(CHART_BAND_FLOOR))
    return (
        tree.where(F.col("level") == "campaign")
        .select(
            "campaign_key",
            F.col("name").alias("label"),
            F.lit(metric).alias("metric"),
            F.coalesce(F.col(metric).cast("double"), F.lit(0.0)).alias("value"),
            colour.alias("colour"),
        )
        .orderBy("campaign_key")
    )
