"""Scored tree and consolidated ("flat") views (H1-H3, M3-M5).

The tree is a flat table with one row per (level, keys); the nested document
form is only built at export time.  Consolidation merges rows whose display
name matches after strip + lower, at the root level and recursively for
their children, and re-scores each group of siblings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import norm_key, round2, safe_div
from .rank import with_position
from .rollup import KEYS
from .scoring import score


def performance_tree(unscored: DataFrame, weights=None) -> DataFrame:
    """H1 + M3 + M4: creatives scored as one pool, campaigns as another;
    ad sets carry no score.  The pool key is the level (three values, so the
    pool statistics are broadcast): one aggregate and one join for the tree."""
    scored = score(unscored, ["level"], weights, bounded_pool=True)
    is_adset = F.col("level") == "adset"
    return scored.withColumn(
        "performance_score", F.when(is_adset, F.lit(None).cast("int")).otherwise(F.col("performance_score"))
    ).withColumn("score_band", F.when(is_adset, F.lit(None).cast("string")).otherwise(F.col("score_band")))


LEVELS = ["campaign", "adset", "creative"]

FLAT_COLUMNS = [
    "level", "depth", "key0", "key1", "key2", "id", "name",
    "spend", "impressions", "clicks", "leads", "appointments", "sales", "revenue",
    "ctr", "cpl", "cac", "roas", "conversion_rate", "appointment_rate", "close_rate",
    "performance_score", "score_band",
    "first_campaign_key", "first_adset_key", "first_creative_key",
]


def _paths(tree: DataFrame, roots: list[str]) -> DataFrame:
    """Each tree row once per root at or above its level, under the path of
    names from that root down (null beyond its depth)."""
    level = F.col("level")
    at = F.when(level == "campaign", 0).when(level == "adset", 1).otherwise(2)
    names = [
        norm_key(F.when(level == "campaign", F.col("name")).otherwise(F.col("campaign_name"))),
        norm_key(F.when(level == "adset", F.col("name")).when(level == "creative", F.col("adset_name"))),
        norm_key(F.when(level == "creative", F.col("name"))),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
    ]
    views = []
    for r in (LEVELS.index(root) for root in roots):
        keys = [names[r + i].alias(f"key{i}") for i in range(3)]
        views.append(F.when(at >= r, F.struct(F.lit(LEVELS[r]).alias("root"), (at - r).alias("depth"), *keys)))
    rows = tree.where(level.isin(LEVELS[min(map(LEVELS.index, roots)):]))
    own = ["level", "name", *KEYS, "spend", "impressions", "clicks", "leads", "appointments", "sales", "revenue"]
    out = rows.select(*own, F.explode(F.array(*views)).alias("view")).where("view is not null")
    return out.select("view.*", *own)


def consolidated_rows(tree: DataFrame, roots: list[str]) -> DataFrame:
    """H3 without scores, for all ``roots`` in one pass over the tree.

    Sums of the *displayed* (rounded) values and of already-distinct counts;
    money re-rounded, ratios recomputed from the sums, first name (tree
    order) kept.  ``pool0`` and ``pool1`` name the siblings of a row: all rows
    of a root's top level are one pool.
    """
    first = F.struct(*KEYS)
    g = _paths(tree, roots).groupBy("root", "level", "depth", "key0", "key1", "key2").agg(
        F.min_by("name", first).alias("name"),
        F.min(first).alias("_first"),
        F.sum(F.col("spend").cast("decimal(38,2)")).alias("_spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("leads").alias("leads"),
        F.sum("appointments").alias("appointments"),
        F.sum("sales").alias("sales"),
        F.sum(F.col("revenue").cast("decimal(38,2)")).alias("_revenue"),
    )
    spend = round2(F.col("_spend").cast("double"))
    revenue = round2(F.col("_revenue").cast("double"))
    own_key = F.coalesce("key2", "key1", "key0")
    m = g.select(
        "root", "level", "depth", "key0", "key1", "key2", own_key.alias("id"), "name",
        F.when(F.col("depth") > 0, F.col("key0")).otherwise("").alias("pool0"),
        F.when(F.col("depth") > 1, F.col("key1")).otherwise("").alias("pool1"),
        spend.alias("spend"), "impressions", "clicks", "leads", "appointments", "sales", revenue.alias("revenue"),
        F.col("_first.campaign_key").alias("first_campaign_key"),
        F.col("_first.adset_key").alias("first_adset_key"),
        F.col("_first.creative_key").alias("first_creative_key"),
    )
    return m.select(
        "*",
        round2(safe_div("clicks", "impressions") * 100).alias("ctr"),
        round2(safe_div("spend", "leads")).alias("cpl"),
        round2(safe_div("spend", "sales")).alias("cac"),
        round2(safe_div("revenue", "spend")).alias("roas"),
        round2(safe_div("leads", "clicks") * 100).alias("conversion_rate"),
        round2(safe_div("appointments", "leads") * 100).alias("appointment_rate"),
        round2(safe_div("sales", "appointments") * 100).alias("close_rate"),
    )


def consolidate(tree: DataFrame, roots: str | list[str], weights=None, store=None) -> DataFrame:
    """H3 + M5 for one root level, or for several with a ``root`` column.

    One expand, one aggregate and one join with the statistics of the pools.
    ``store`` writes a table and reads it back: the consolidated rows feed
    both the statistics and the scores, and go through it so that the tree is
    read once.
    """
    several = not isinstance(roots, str)
    rows = consolidated_rows(tree, roots if several else [roots])
    rows = store(rows) if store else rows
    scored = score(rows, ["root", "depth", "pool0", "pool1"], weights, spread=F.col("depth") == 0)
    return scored.select(*(["root"] if several else []), *FLAT_COLUMNS)


_METRICS = [
    "spend", "impressions", "clicks", "leads", "appointments", "sales", "revenue",
    "ctr", "cpl", "cac", "roas", "conversion_rate", "appointment_rate", "close_rate",
]
CHILDREN_A_ROW = 1000


def nested_export(tree: DataFrame, children: int = CHILDREN_A_ROW) -> DataFrame:
    """H1 nested form: a row per campaign or ad set and chunk of its children.

    ``node`` is the parent's own record, ``children`` at most that many records
    of the level below, sorted by key; ``chunk`` numbers the rows of a parent
    from 0. A parent without children has one row with none. Places come from
    ranges and counts (``rank.with_position``), so no row, task or window holds
    all children of a parent.
    """
    record = F.struct("level", "id", *KEYS, "name", "campaign_name", "adset_name", *_METRICS, "performance_score", "score_band")
    rows = tree.select(F.col("level").alias("child_level"), "campaign_key", F.when(F.col("level") == "creative", F.col("adset_key")).alias("parent_adset"), "adset_key", "creative_key", record.alias("record"))
    below = rows.where(F.col("child_level") != "campaign")
    order = [F.col("child_level").asc(), F.col("campaign_key").asc(), F.col("parent_adset").asc_nulls_first(), F.col("adset_key").asc(), F.col("creative_key").asc_nulls_first()]
    placed = with_position(below, order, "place")
    parent = ["child_level", "campaign_key", "parent_adset"]
    first = placed.groupBy(*parent).agg(F.min("place").alias("first")).select(*(F.col(c).alias(f"p{i}") for i, c in enumerate(parent)), "first")
    on = (F.col("child_level") == F.col("p0")) & (F.col("campaign_key") == F.col("p1")) & F.col("parent_adset").eqNullSafe(F.col("p2"))
    chunk = F.floor((F.col("place") - F.col("first")) / children).cast("int")
    chunks = placed.join(first, on).select(*parent, chunk.alias("chunk"), F.struct("place", "record").alias("c"))
    chunks = chunks.groupBy(*parent, "chunk").agg(F.array_sort(F.collect_list("c")).alias("c"))  # at most ``children``
    chunks = chunks.select(*(F.col(c).alias(f"p{i}") for i, c in enumerate(parent)), "chunk", F.col("c.record").alias("children"))
    nodes = tree.where(F.col("level") != "creative").select("level", "campaign_key", "adset_key", record.alias("node"))
    of = (F.col("p0") == F.when(F.col("level") == "campaign", "adset").otherwise("creative")) & (F.col("campaign_key") == F.col("p1")) & F.col("adset_key").eqNullSafe(F.col("p2"))
    out = nodes.join(chunks, of, "left")
    none = F.array().cast(chunks.schema["children"].dataType)
    return out.select("level", "campaign_key", "adset_key", F.coalesce("chunk", F.lit(0)).alias("chunk"), "node", F.coalesce("children", none).alias("children"))


def parsed_back(nested: DataFrame) -> DataFrame:
    """The tree rows that a nested export holds: its campaigns, and all children."""
    tops = nested.where("level = 'campaign' and chunk = 0").select("node.*")
    return tops.unionByName(nested.select(F.explode("children").alias("c")).select("c.*"))
