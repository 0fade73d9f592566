"""Registered queries: one per operator, each with (spark_fn, oracle_sql).

``spark_fn(spark, sf_dir) -> DataFrame`` builds the plan over the driver
tables in ``sf_dir``; the SQL (or None) is the DuckDB formulation used by
the correctness check.  Every query reads the whole driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.clean import guess_dates, norm_key, parse_date, parse_money, parse_number, round2
from ..operators import filters as FL
from ..operators import quality as Q
from ..operators import rank as R
from ..operators import rollup as RU
from ..operators import rules as RL
from ..operators import scoring as S
from ..sources import fixtures as FX
from ..sources import ingest as IN
from . import oracle as O
from .funnel import Funnel

QueryFn = Callable[[SparkSession, str], DataFrame]

_ORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_METRICS = (
    "spend, impressions, clicks, leads, appointments, sales, revenue, ctr, cpl, cac, roas, "
    "conversion_rate, appointment_rate, close_rate"
)
_METRIC_LIST = [m.strip() for m in _METRICS.split(",")]
_TREE_COLS = "level, id, campaign_key, adset_key, creative_key, name, campaign_name, adset_name, " + _METRICS
_FLAT_COLS = (
    "level, depth, key0, key1, key2, id, name, " + _METRICS + ", performance_score, score_band, "
    "first_campaign_key, first_adset_key, first_creative_key"
)


def funnel(spark: SparkSession, sf_dir: str, config: C.FunnelConfig | None = None, materialize: bool = True) -> Funnel:
    return Funnel(FX.silver_tables(spark, sf_dir), config or FX.FIXTURE_CONFIG, materialize=materialize)


def _ord_cols(prefix: str = "ordinal") -> list:
    return [F.col(f"{prefix}.{c}").alias(c) for c in _ORD]


def _sql(body: str) -> str:
    return O.prelude() + "\n" + body


def _cols(names: str) -> list[str]:
    return [c.strip() for c in names.split(",")]


QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = (fn, sql)
        return fn

    return deco


# ---------------------------------------------------------------------------
# Flagship and tree
# ---------------------------------------------------------------------------

@register("campaign_performance", _sql(f"SELECT campaign_key, name, {_METRICS} FROM tree0 WHERE level = 'campaign'"))
def q_campaign_performance(spark, sf):
    t = funnel(spark, sf).unscored_tree
    return t.where(F.col("level") == "campaign").select("campaign_key", "name", *_METRIC_LIST)


@register("adset_performance", _sql(f"SELECT campaign_key, adset_key, name, campaign_name, {_METRICS} FROM tree0 WHERE level = 'adset'"))
def q_adset_performance(spark, sf):
    t = funnel(spark, sf).unscored_tree
    return t.where(F.col("level") == "adset").select("campaign_key", "adset_key", "name", "campaign_name", *_METRIC_LIST)


@register(
    "creative_performance",
    _sql(f"SELECT campaign_key, adset_key, creative_key, name, campaign_name, adset_name, {_METRICS} FROM tree0 WHERE level = 'creative'"),
)
def q_creative_performance(spark, sf):
    t = funnel(spark, sf).unscored_tree
    return t.where(F.col("level") == "creative").select(*RU.KEYS, "name", "campaign_name", "adset_name", *_METRIC_LIST)


@register("ratio_pack", _sql("SELECT level, id, ctr, cpl, cac, roas, conversion_rate, appointment_rate, close_rate FROM tree0"))
def q_ratio_pack(spark, sf):
    return funnel(spark, sf).unscored_tree.select("level", "id", *RU.RATIO_COLUMNS)


@register("performance_tree", _sql(f"SELECT {_TREE_COLS}, performance_score, score_band FROM tree"))
def q_performance_tree(spark, sf):
    return funnel(spark, sf).tree.select(*_cols(_TREE_COLS), "performance_score", "score_band")


@register("all_creatives", _sql(f"SELECT {_TREE_COLS}, performance_score, score_band FROM tree WHERE level = 'creative'"))
def q_all_creatives(spark, sf):
    return funnel(spark, sf).tree.where(F.col("level") == "creative").select(*_cols(_TREE_COLS), "performance_score", "score_band")


@register("all_adsets", _sql(f"SELECT {_TREE_COLS} FROM tree WHERE level = 'adset'"))
def q_all_adsets(spark, sf):
    return funnel(spark, sf).tree.where(F.col("level") == "adset").select(*_cols(_TREE_COLS))


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------

@register("creative_scores", _sql("SELECT id, roas, cpl, ctr, performance_score, score_band FROM tree WHERE level = 'creative'"))
def q_creative_scores(spark, sf):
    t = funnel(spark, sf).tree
    return t.where(F.col("level") == "creative").select("id", "roas", "cpl", "ctr", "performance_score", "score_band")


@register("campaign_scores", _sql("SELECT id, roas, cpl, ctr, performance_score, score_band FROM tree WHERE level = 'campaign'"))
def q_campaign_scores(spark, sf):
    t = funnel(spark, sf).tree
    return t.where(F.col("level") == "campaign").select("id", "roas", "cpl", "ctr", "performance_score", "score_band")


@register("performance_scores", _sql("SELECT id, roas, cpl, ctr, performance_score, score_band FROM cons_creative WHERE depth = 0"))
def q_performance_scores(spark, sf):
    f = funnel(spark, sf).creatives_flat
    return f.where(F.col("depth") == 0).select("id", "roas", "cpl", "ctr", "performance_score", "score_band")


@register(
    "sibling_scores",
    _sql("SELECT level, depth, key0, key1, key2, roas, cpl, ctr, performance_score, score_band FROM cons_campaign WHERE depth > 0"),
)
def q_sibling_scores(spark, sf):
    f = funnel(spark, sf).campaigns_flat
    return f.where(F.col("depth") > 0).select(
        "level", "depth", "key0", "key1", "key2", "roas", "cpl", "ctr", "performance_score", "score_band"
    )


def _minmax_sql() -> str:
    parts = []
    for m, _, inv in C.SCORE_WEIGHTS:
        norm = f"(t.{m} - s.mn_{m}) / (s.mx_{m} - s.mn_{m})"
        if inv:
            norm = f"(1 - {norm})"
        parts.append(f"CASE WHEN s.mx_{m} = s.mn_{m} THEN CAST(0.5 AS DOUBLE) ELSE {norm} END AS {m}_norm")
    stats = ", ".join(f"min({m}) AS mn_{m}, max({m}) AS mx_{m}" for m, _, _ in C.SCORE_WEIGHTS)
    return _sql(
        f"SELECT t.id, {', '.join(parts)} FROM (SELECT * FROM tree WHERE level = 'creative') t "
        f"CROSS JOIN (SELECT {stats} FROM tree WHERE level = 'creative') s"
    )


@register("minmax_normalise", _minmax_sql())
def q_minmax_normalise(spark, sf):
    cre = funnel(spark, sf).tree.where(F.col("level") == "creative")
    aggs = []
    for m, _, _ in C.SCORE_WEIGHTS:
        aggs += [F.min(m).alias(f"mn_{m}"), F.max(m).alias(f"mx_{m}")]
    j = cre.crossJoin(F.broadcast(cre.agg(*aggs)))
    return j.select(
        "id",
        *[S.normalised(F.col(m), F.col(f"mn_{m}"), F.col(f"mx_{m}"), inv).alias(f"{m}_norm") for m, _, inv in C.SCORE_WEIGHTS],
    )


@register("score_band", _sql("SELECT level, score_band, count(*) AS n FROM tree WHERE score_band IS NOT NULL GROUP BY level, score_band"))
def q_score_band(spark, sf):
    t = funnel(spark, sf).tree
    return t.where(F.col("score_band").isNotNull()).groupBy("level", "score_band").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Consolidated views and rankings
# ---------------------------------------------------------------------------

@register("campaigns_flat", _sql(f"SELECT {_FLAT_COLS} FROM cons_campaign WHERE depth = 0"))
def q_campaigns_flat(spark, sf):
    return funnel(spark, sf).campaigns_flat.where(F.col("depth") == 0)


@register("campaigns_flat_children", _sql(f"SELECT {_FLAT_COLS} FROM cons_campaign WHERE depth > 0"))
def q_campaigns_flat_children(spark, sf):
    return funnel(spark, sf).campaigns_flat.where(F.col("depth") > 0)


@register("adsets_flat", _sql(f"SELECT {_FLAT_COLS} FROM cons_adset WHERE depth = 0"))
def q_adsets_flat(spark, sf):
    return funnel(spark, sf).adsets_flat.where(F.col("depth") == 0)


@register("adsets_flat_children", _sql(f"SELECT {_FLAT_COLS} FROM cons_adset WHERE depth = 1"))
def q_adsets_flat_children(spark, sf):
    return funnel(spark, sf).adsets_flat.where(F.col("depth") == 1)


@register("creatives_flat", _sql(f"SELECT {_FLAT_COLS} FROM cons_creative"))
def q_creatives_flat(spark, sf):
    return funnel(spark, sf).creatives_flat


_RANK_COLS = "id, name, performance_score, score_band, cpl, ctr, leads"


@register(
    "top_creatives",
    _sql(
        f"SELECT CAST(row_number() OVER (ORDER BY performance_score DESC, first_campaign_key, first_adset_key, first_creative_key) AS INTEGER) AS rank, "
        f"{_RANK_COLS} FROM cons_creative WHERE depth = 0 ORDER BY rank LIMIT {C.RANKING_SIZE}"
    ),
)
def q_top_creatives(spark, sf):
    return funnel(spark, sf).top_creatives.select("rank", *_cols(_RANK_COLS))


@register(
    "bottom_creatives",
    _sql(
        f"SELECT CAST(row_number() OVER (ORDER BY performance_score ASC, first_campaign_key DESC, first_adset_key DESC, first_creative_key DESC) AS INTEGER) AS rank, "
        f"{_RANK_COLS} FROM cons_creative WHERE depth = 0 ORDER BY rank LIMIT {C.RANKING_SIZE}"
    ),
)
def q_bottom_creatives(spark, sf):
    return funnel(spark, sf).bottom_creatives.select("rank", *_cols(_RANK_COLS))


@register(
    "rankings",
    _sql(
        f"SELECT 'top' AS list, * FROM (SELECT CAST(row_number() OVER (ORDER BY performance_score DESC, first_campaign_key, first_adset_key, first_creative_key) AS INTEGER) AS rank, "
        f"{_RANK_COLS} FROM cons_creative WHERE depth = 0 ORDER BY rank LIMIT {C.RANKING_SIZE}) "
        f"UNION ALL SELECT 'bottom', * FROM (SELECT CAST(row_number() OVER (ORDER BY performance_score ASC, first_campaign_key DESC, first_adset_key DESC, first_creative_key DESC) AS INTEGER) AS rank, "
        f"{_RANK_COLS} FROM cons_creative WHERE depth = 0 ORDER BY rank LIMIT {C.RANKING_SIZE})"
    ),
)
def q_rankings(spark, sf):
    """Both ranked lists with the position shown next to each name."""
    f = funnel(spark, sf)
    top = f.top_creatives.select(F.lit("top").alias("list"), "rank", *_cols(_RANK_COLS))
    bottom = f.bottom_creatives.select(F.lit("bottom").alias("list"), "rank", *_cols(_RANK_COLS))
    return top.unionByName(bottom)


def _tree_sorted_sql() -> str:
    return _sql(
        f"""SELECT t.level, t.id, t.spend, c.spend AS sort0,
              CASE WHEN t.level = 'adset' THEN t.spend WHEN t.level = 'creative' THEN a.spend END AS sort1,
              CASE WHEN t.level = 'creative' THEN t.spend END AS sort2
            FROM tree t
            LEFT JOIN (SELECT campaign_key, spend FROM tree WHERE level = 'campaign') c ON t.campaign_key = c.campaign_key
            LEFT JOIN (SELECT campaign_key, adset_key, spend FROM tree WHERE level = 'adset') a
              ON t.campaign_key = a.campaign_key AND t.adset_key = a.adset_key"""
    )


@register("tree_sorted", _tree_sorted_sql())
def q_tree_sorted(spark, sf):
    return R.tree_sorted(funnel(spark, sf).tree, "spend", True).select("level", "id", "spend", "sort0", "sort1", "sort2")


@register("flat_sorted", _sql("SELECT id, name, coalesce(CAST(cpl AS DOUBLE), 0.0) AS sort_value FROM cons_creative WHERE depth = 0"))
def q_flat_sorted(spark, sf):
    return R.flat_sorted(funnel(spark, sf).creatives_flat, "cpl", False).select("id", "name", "sort_value")


def _tree_position_sql() -> str:
    return _sql(
        """SELECT level, id, row_number() OVER (ORDER BY sort0 DESC NULLS LAST, campaign_key, adset_key IS NOT NULL, sort1 DESC NULLS LAST, adset_key,
              creative_key IS NOT NULL, sort2 DESC NULLS LAST, creative_key) AS position
            FROM (SELECT t.*, c.spend AS sort0, CASE WHEN t.level = 'adset' THEN t.spend WHEN t.level = 'creative' THEN a.spend END AS sort1,
                CASE WHEN t.level = 'creative' THEN t.spend END AS sort2 FROM tree t
              LEFT JOIN (SELECT campaign_key, spend FROM tree WHERE level = 'campaign') c ON t.campaign_key = c.campaign_key
              LEFT JOIN (SELECT campaign_key, adset_key, spend FROM tree WHERE level = 'adset') a
                ON t.campaign_key = a.campaign_key AND t.adset_key = a.adset_key)"""
    )


@register("tree_positions", _tree_position_sql())
def q_tree_positions(spark, sf):
    """The place of every tree row in the display order."""
    return R.with_position(*R.tree_order(funnel(spark, sf).tree, "spend", True)).select("level", "id", "position")


@register(
    "flat_positions",
    _sql(
        "SELECT id, row_number() OVER (ORDER BY coalesce(CAST(cpl AS DOUBLE), 0.0), first_campaign_key, first_adset_key, first_creative_key) AS position "
        "FROM cons_creative WHERE depth = 0"
    ),
)
def q_flat_positions(spark, sf):
    """The place of every consolidated creative by cost per lead."""
    return R.with_position(*R.flat_order(funnel(spark, sf).creatives_flat, "cpl", False)).select("id", "position")


@register("campaign_names", _sql("SELECT DISTINCT name FROM tree WHERE level = 'campaign'"))
def q_campaign_names(spark, sf):
    return R.campaign_names(funnel(spark, sf).tree)


def _chart_sql(metric: str) -> str:
    s = f"coalesce(performance_score, {C.DEFAULT_MISSING_SCORE})"
    whens = " ".join(f"WHEN {s} >= {lo} THEN {O.lit(n)}" for lo, n in C.CHART_BANDS)
    return _sql(
        f"SELECT campaign_key, name AS label, '{metric}' AS metric, coalesce(CAST({metric} AS DOUBLE), 0.0) AS value, "
        f"CASE {whens} ELSE {O.lit(C.CHART_BAND_FLOOR)} END AS colour FROM tree WHERE level = 'campaign'"
    )


@register("chart_series", _chart_sql("cpl"))
def q_chart_series(spark, sf):
    return R.chart_series(funnel(spark, sf).tree, "cpl")


# ---------------------------------------------------------------------------
# Aggregations and attribution
# ---------------------------------------------------------------------------

@register(
    "ads_rollup",
    _sql("SELECT level, campaign_key, adset_key, creative_key, name, CAST(spend_sum AS DOUBLE) AS spend, impressions, clicks, reach FROM rollup"),
)
def q_ads_rollup(spark, sf):
    r = funnel(spark, sf).rollup
    return r.select("level", *RU.KEYS, "name", F.col("spend_sum").cast("double").alias("spend"), "impressions", "clicks", "reach")


def _ads_level_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    return _sql(
        f"SELECT {k}, CAST(sum(spend) AS DOUBLE) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks, "
        f"sum(reach) AS reach FROM ads_k WHERE {nn} GROUP BY {k}"
    )


def _ads_level(spark, sf, keys: list[str]) -> DataFrame:
    f = funnel(spark, sf)
    k = RU.keyed_ads(f.ads_f, True, True, f.has_order)
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).isNotNull()
    return k.where(cond).groupBy(*keys).agg(
        F.sum("spend").cast("double").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("reach").alias("reach"),
    )


@register("ads_by_campaign", _ads_level_sql(["campaign_key"]))
def q_ads_by_campaign(spark, sf):
    return _ads_level(spark, sf, ["campaign_key"])


@register("ads_by_adset", _ads_level_sql(["campaign_key", "adset_key"]))
def q_ads_by_adset(spark, sf):
    return _ads_level(spark, sf, ["campaign_key", "adset_key"])


@register("ads_by_creative", _ads_level_sql(["campaign_key", "adset_key", "creative_key"]))
def q_ads_by_creative(spark, sf):
    return _ads_level(spark, sf, ["campaign_key", "adset_key", "creative_key"])


@register("ads_totals", _sql("SELECT CAST(spend AS DOUBLE) AS spend, impressions, clicks, reach FROM ads_tot"))
def q_ads_totals(spark, sf):
    t = funnel(spark, sf).ads_totals
    return t.select(F.col("spend").cast("double").alias("spend"), "impressions", "clicks", "reach")


@register("display_names", _sql("SELECT level, campaign_key, adset_key, creative_key, name FROM rollup"))
def q_display_names(spark, sf):
    return funnel(spark, sf).rollup.select("level", *RU.KEYS, "name")


@register(
    "funnel_totals",
    _sql("SELECT CAST(total_leads AS BIGINT) AS total_leads, CAST(total_appointments AS BIGINT) AS total_appointments, "
         "CAST(total_sales AS BIGINT) AS total_sales, CAST(revenue AS DOUBLE) AS total_revenue FROM fun_tot"),
)
def q_funnel_totals(spark, sf):
    t = funnel(spark, sf).funnel_totals
    return t.select(
        F.col("total_leads").cast("long").alias("total_leads"),
        F.col("total_appointments").cast("long").alias("total_appointments"),
        F.col("total_sales").cast("long").alias("total_sales"),
        F.col("revenue").cast("double").alias("total_revenue"),
    )


@register(
    "revenue_by_email",
    _sql(f"SELECT {O.key('email')} AS email, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales_f WHERE {O.key('email')} IS NOT NULL GROUP BY 1"),
)
def q_revenue_by_email(spark, sf):
    e = funnel(spark, sf).emails.where((F.col("has_sale") == 1) & F.col("email").isNotNull())
    return e.select("email", F.col("revenue").cast("double").alias("revenue"))


@register("leads_by_level", _sql("SELECT level, campaign_key, adset_key, creative_key, leads FROM lead_facts"))
def q_leads_by_level(spark, sf):
    return funnel(spark, sf).lead_facts.select("level", *RU.KEYS, F.col("leads").cast("long").alias("leads"))


@register("leads_with_appt", _sql("SELECT level, campaign_key, adset_key, creative_key, appointments FROM lead_facts"))
def q_leads_with_appt(spark, sf):
    return funnel(spark, sf).lead_facts.select("level", *RU.KEYS, F.col("appointments").cast("long").alias("appointments"))


@register("leads_with_sale", _sql("SELECT level, campaign_key, adset_key, creative_key, sales FROM lead_facts"))
def q_leads_with_sale(spark, sf):
    return funnel(spark, sf).lead_facts.select("level", *RU.KEYS, F.col("sales").cast("long").alias("sales"))


@register("attributed_revenue", _sql("SELECT level, campaign_key, adset_key, creative_key, CAST(revenue AS DOUBLE) AS revenue FROM lead_facts"))
def q_attributed_revenue(spark, sf):
    return funnel(spark, sf).lead_facts.select("level", *RU.KEYS, F.col("revenue").cast("double").alias("revenue"))


@register("appts_by_campaign", _sql("SELECT campaign_key, appointments FROM appts_c"))
def q_appts_by_campaign(spark, sf):
    return funnel(spark, sf).appts_by_campaign


@register("sales_by_campaign", _sql("SELECT campaign_key, sales, CAST(revenue AS DOUBLE) AS revenue FROM sales_c"))
def q_sales_by_campaign(spark, sf):
    s = funnel(spark, sf).sales_by_campaign
    return s.select("campaign_key", "sales", F.col("revenue").cast("double").alias("revenue"))


@register("kpis", _sql("SELECT * FROM kpis"))
def q_kpis(spark, sf):
    return funnel(spark, sf).kpis


@register(
    "date_span",
    _sql("SELECT strftime(min(date), '%Y-%m-%d') AS date_start, strftime(max(date), '%Y-%m-%d') AS date_end FROM ads_f"),
)
def q_date_span(spark, sf):
    return funnel(spark, sf).date_span


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------

def _rows_sql(src: str, where: str = "TRUE", extra: str = "") -> str:
    return _sql(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date{extra} FROM {src} WHERE {where}")


@register("ads_keyword_filter", _rows_sql("f_ads", f"coalesce(contains(upper(campaign), '{FX.FIXTURE_CONFIG.ads_keyword}'), false)", ", campaign"))
def q_ads_keyword_filter(spark, sf):
    ads = FX.silver_tables(spark, sf).ads
    return ads.where(FL.ads_keyword(FX.FIXTURE_CONFIG)).select(*_ord_cols(), "date", "campaign")


@register("ads_date_filter", _rows_sql("ads_f"))
def q_ads_date_filter(spark, sf):
    return funnel(spark, sf).ads_f.select(*_ord_cols(), "date")


@register("leads_keyword_filter", _rows_sql("f_leads", f"coalesce(contains(upper(campaign), '{FX.FIXTURE_CONFIG.leads_keyword}'), false)", ", campaign"))
def q_leads_keyword_filter(spark, sf):
    leads = FX.silver_tables(spark, sf).leads
    return leads.where(FL.leads_keyword(FX.FIXTURE_CONFIG)).select(*_ord_cols(), "date", "campaign")


@register(
    "funnel_date_filter",
    _sql(
        "SELECT 'leads' AS tbl, l_orderkey, l_linenumber, l_partkey, l_suppkey, date FROM leads_f "
        "UNION ALL SELECT 'appointments', l_orderkey, l_linenumber, l_partkey, l_suppkey, date FROM appts_f "
        "UNION ALL SELECT 'sales', l_orderkey, l_linenumber, l_partkey, l_suppkey, date FROM sales_f"
    ),
)
def q_funnel_date_filter(spark, sf):
    f = funnel(spark, sf)
    parts = [d.select(F.lit(n).alias("tbl"), *_ord_cols(), "date") for n, d in (("leads", f.leads_f), ("appointments", f.appts_f), ("sales", f.sales_f))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("appts_traffic_filter", _rows_sql("f_appts", f"coalesce({O.strip('campaign')} <> '', false)"))
def q_appts_traffic_filter(spark, sf):
    a = FX.silver_tables(spark, sf).appointments
    return a.where(FL.appointment_has_campaign()).select(*_ord_cols(), "date")


@register(
    "sales_segment_filter",
    _rows_sql(
        "f_sales",
        f"upper({O.strip('product')}) = {O.lit(FX.FIXTURE_CONFIG.sales_product)} AND upper({O.strip('origin')}) = {O.lit(FX.FIXTURE_CONFIG.sales_origin)}",
        ", CAST(revenue AS DOUBLE) AS revenue",
    ),
)
def q_sales_segment_filter(spark, sf):
    s = FX.silver_tables(spark, sf).sales
    kept = FL.filter_sales(s, FX.FIXTURE_CONFIG, has_date=False)
    return kept.select(*_ord_cols(), "date", F.col("revenue").cast("double").alias("revenue"))


@register(
    "campaign_filter",
    _sql(f"SELECT {_TREE_COLS} FROM tree WHERE campaign_key IN (SELECT campaign_key FROM tree WHERE level = 'campaign' AND contains(lower(name), 'large'))"),
)
def q_campaign_filter(spark, sf):
    return funnel(spark, sf).tree_filtered("Large").select(*_cols(_TREE_COLS))


@register("table_search", _sql(f"SELECT {_TREE_COLS} FROM tree WHERE level = 'creative' AND contains(lower(name), 'gear')"))
def q_table_search(spark, sf):
    return FL.table_search(funnel(spark, sf).tree, "GEAR", "creative").select(*_cols(_TREE_COLS))


@register("level_view", _sql(f"SELECT {_FLAT_COLS} FROM cons_adset"))
def q_level_view(spark, sf):
    return funnel(spark, sf).level_view("adset")


# ---------------------------------------------------------------------------
# Set operations and diagnostics
# ---------------------------------------------------------------------------

@register("appt_ads_overlap", _sql(f"SELECT {O.key('campaign')} AS campaign_key FROM appts_f INTERSECT SELECT {O.key('campaign')} FROM ads_f"))
def q_appt_ads_overlap(spark, sf):
    f = funnel(spark, sf)
    return f.key_overlap("appointments")


@register("sales_ads_overlap", _sql(f"SELECT {O.key('campaign')} AS campaign_key FROM sales_f INTERSECT SELECT {O.key('campaign')} FROM ads_f"))
def q_sales_ads_overlap(spark, sf):
    f = funnel(spark, sf)
    return f.key_overlap("sales")


@register(
    "campaign_keys",
    _sql(
        f"SELECT DISTINCT tbl AS \"table\", campaign_key FROM ("
        f"SELECT 'ads' AS tbl, {O.key('campaign')} AS campaign_key FROM ads_f "
        f"UNION ALL SELECT 'appointments', {O.key('campaign')} FROM appts_f "
        f"UNION ALL SELECT 'sales', {O.key('campaign')} FROM sales_f WHERE {O.key('campaign')} <> '') WHERE campaign_key IS NOT NULL"
    ),
)
def q_campaign_keys(spark, sf):
    return funnel(spark, sf).campaign_keys()


@register(
    "campaign_match",
    _sql("SELECT campaign_key, name, leads, appointments, sales, revenue FROM tree WHERE level = 'campaign' AND (appointments > 0 OR sales > 0)"),
)
def q_campaign_match(spark, sf):
    return funnel(spark, sf).campaign_match()


def _audit_sql(cfg: C.FunnelConfig, start_sql: str, end_sql: str) -> str:
    day = f"date >= {start_sql} AND date < CAST(CAST({end_sql} AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)"
    ads_rng = f"date >= {start_sql} AND date <= {end_sql}"
    kw = lambda k: f"coalesce(contains(upper(campaign), {O.lit(k)}), false)"
    prod = f"coalesce(upper({O.strip('product')}) = {O.lit(cfg.sales_product)}, false)"
    orig = f"coalesce(upper({O.strip('origin')}) = {O.lit(cfg.sales_origin)}, false)"
    camp = f"coalesce({O.strip('campaign')} <> '', false)"

    def audit(table: str, src: str, steps: list[tuple[str, str]]) -> str:
        sel = ["count(*) AS s0"]
        cond = "TRUE"
        for i, (_, p) in enumerate(steps, start=1):
            cond = f"{cond} AND coalesce({p}, false)"
            sel.append(f"count(CASE WHEN {cond} THEN 1 END) AS s{i}")
        names = ["loaded"] + [n for n, _ in steps]
        rows = " UNION ALL ".join(
            f"SELECT '{table}' AS \"table\", {i} AS step_no, {O.lit(n)} AS step, CAST(s{i} AS BIGINT) AS \"rows\" FROM c" for i, n in enumerate(names)
        )
        return f"(WITH c AS (SELECT {', '.join(sel)} FROM {src}) {rows})"

    parts = [
        audit("ads", "f_ads", [("campaign keyword", kw(cfg.ads_keyword)), ("date range", ads_rng)]),
        audit("leads", "f_leads", [("campaign keyword", kw(cfg.leads_keyword)), ("date range", day)]),
        audit("appointments", "f_appts", [("campaign present", camp), ("date range", day)]),
        audit("sales", "f_sales", [("product", prod), ("origin", orig), ("date range", day)]),
    ]
    return _sql("SELECT * FROM " + " UNION ALL SELECT * FROM ".join(parts))


@register("filter_audit", _audit_sql(FX.FIXTURE_CONFIG, O.TS_START, O.TS_END))
def q_filter_audit(spark, sf):
    f = funnel(spark, sf)
    return Q.filter_audit(f.tables.ads, f.tables.leads, f.tables.appointments, f.tables.sales, f.cfg).select(
        "table", F.col("step_no").cast("int").alias("step_no"), "step", "rows"
    )


@register(
    "default_range",
    _audit_sql(
        C.FunnelConfig(), f"TIMESTAMP '{C.DEFAULT_DATE_START} 00:00:00'", "CAST(CAST((now() AT TIME ZONE 'UTC') AS DATE) AS TIMESTAMP)"
    ),
)
def q_default_range(spark, sf):
    """the default window (2025-12-01 .. today UTC) applied to the same tables."""
    t = FX.silver_tables(spark, sf)
    cfg = C.FunnelConfig().resolved()
    return Q.filter_audit(t.ads, t.leads, t.appointments, t.sales, cfg).select(
        "table", F.col("step_no").cast("int").alias("step_no"), "step", "rows"
    )


_YEARS_ON = 30


def _recent_sql() -> str:
    """The audit's SQL over tables whose dates lie ``_YEARS_ON`` years later."""
    sql = _audit_sql(C.FunnelConfig(), f"TIMESTAMP '{C.DEFAULT_DATE_START} 00:00:00'", "CAST(CAST((now() AT TIME ZONE 'UTC') AS DATE) AS TIMESTAMP)")
    head = O.prelude()
    later = ", ".join(f"r_{t} AS (SELECT * REPLACE (date + INTERVAL {_YEARS_ON} YEAR AS date) FROM f_{t})" for t in ("ads", "leads", "appts", "sales"))
    body = sql[len(head):]
    for t in ("ads", "leads", "appts", "sales"):
        body = body.replace(f"FROM f_{t})", f"FROM r_{t})")
    return f"{head}, {later}{body}"


@register("default_range_recent", _recent_sql())
def q_default_range_recent(spark, sf):
    """the default window (2025-12-01 .. today UTC) on tables with recent dates, so that it holds rows."""
    t = FX.silver_tables(spark, sf)
    later = (F.col("date") + F.make_ym_interval(F.lit(_YEARS_ON))).alias("date")
    recent = [df.drop(FL.MONTH).withColumn("date", later) for df in t.as_dict().values()]
    return Q.filter_audit(*recent, C.FunnelConfig().resolved()).select("table", F.col("step_no").cast("int").alias("step_no"), "step", "rows")


# ---------------------------------------------------------------------------
# Alerts, recommendations, digest, classes
# ---------------------------------------------------------------------------

def _alert_candidates_sql() -> str:
    avg = "(SELECT overall_cpl FROM kpis)"
    score = f"coalesce(performance_score, {C.DEFAULT_MISSING_SCORE})"
    fields = {
        "ctr": "ctr", "conversion_rate": "conversion_rate", "cpl": "cpl", "roas": "roas",
        "appointment_rate": "appointment_rate", "score": score, "level": "level", "name": "name",
        "cpl_excess_pct": f"CASE WHEN {avg} > 0 THEN (cpl / {avg} - 1) * 100 ELSE 0.0 END",
    }
    conds = {
        1: f"ctr > 0 AND ctr < {C.LOW_CTR} AND spend > 0",
        2: f"ctr > {C.LP_CTR} AND conversion_rate < {C.LP_CVR} AND spend > 0 AND conversion_rate > 0",
        3: f"{avg} > 0 AND cpl > {avg} * {C.CPL_FACTOR} AND spend > 0",
        4: f"leads > {C.APPT_MIN_LEADS} AND appointment_rate < {C.APPT_RATE} AND level = 'campaign'",
        5: f"{score} >= {C.SCALE_SCORE} AND spend > 0 AND level = 'creative'",
        6: f"roas > 0 AND roas < {C.BREAKEVEN_ROAS} AND spend > 0",
    }
    parts = []
    for rule_no, kind, icon, metric, action in C.ALERT_RULES:
        parts.append(
            f"SELECT level, campaign_key, adset_key, creative_key, name AS entity, {rule_no} AS rule_no, {O.lit(kind)} AS type, "
            f"{O.lit(icon)} AS icon, {O.lit(metric)} AS metric, {O.render(C.ALERT_VALUE_TEMPLATES[rule_no], fields)} AS value, "
            f"{O.render(C.ALERT_MESSAGE_TEMPLATES[rule_no], fields)} AS message, {O.lit(action)} AS action "
            f"FROM tree WHERE {conds[rule_no]}"
        )
    return " UNION ALL ".join(parts)


_ALERT_COLS = "level, campaign_key, adset_key, creative_key, entity, rule_no, type, icon, metric, value, message, action"


def _alert_rule(rule_no: int):
    sql = _sql(f"SELECT {_ALERT_COLS} FROM ({_alert_candidates_sql()}) WHERE rule_no = {rule_no}")

    def fn(spark, sf):
        f = funnel(spark, sf)
        return RL.alert_candidates(f.tree, f.kpis).where(F.col("rule_no") == rule_no).select(*_cols(_ALERT_COLS))

    return fn, sql


for _no, _name in [
    (1, "alert_low_ctr"), (2, "alert_landing_page"), (3, "alert_high_cpl"),
    (4, "alert_low_appt"), (5, "alert_scale"), (6, "alert_low_roas"),
]:
    QUERIES[_name] = _alert_rule(_no)

_DFS_SQL = "campaign_key, adset_key NULLS FIRST, creative_key NULLS FIRST, rule_no"


@register(
    "rule_alerts",
    _sql(
        f"SELECT CAST(row_number() OVER (ORDER BY {_DFS_SQL}) AS INTEGER) AS position, rule_no, type, icon, level, entity, metric, value, message, action "
        f"FROM (SELECT * FROM ({_alert_candidates_sql()}) QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY {_DFS_SQL}) = 1) "
        f"ORDER BY position LIMIT {C.ALERT_CAP}"
    ),
)
def q_rule_alerts(spark, sf):
    f = funnel(spark, sf)
    return f.alerts.select("position", "rule_no", "type", "icon", "level", "entity", "metric", "value", "message", "action")


def _recommend_sql() -> str:
    s = f"coalesce(performance_score, {C.DEFAULT_MISSING_SCORE})"
    hi, hi_a, hi_c = C.RECOMMEND_SCALE
    lo, lo_a, lo_c = C.RECOMMEND_PAUSE
    t_a, t_c = C.RECOMMEND_TEST
    fields = {"score": s, "cpl": "cpl"}
    reason = (
        f"CASE WHEN {s} >= {hi} THEN {O.render(C.RECOMMEND_REASON_TEMPLATES[hi_a], fields)} "
        f"WHEN {s} <= {lo} THEN {O.render(C.RECOMMEND_REASON_TEMPLATES[lo_a], fields)} "
        f"ELSE {O.render(C.RECOMMEND_REASON_TEMPLATES[t_a], fields)} END"
    )
    order = f"{s} DESC, campaign_key, adset_key NULLS FIRST, creative_key NULLS FIRST"
    return _sql(
        f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position, name AS creative, coalesce(campaign_name, '') AS campaign, "
        f"coalesce(adset_name, '') AS adset, "
        f"CASE WHEN {s} >= {hi} THEN {O.lit(hi_a)} WHEN {s} <= {lo} THEN {O.lit(lo_a)} ELSE {O.lit(t_a)} END AS action, "
        f"CASE WHEN {s} >= {hi} THEN {O.lit(hi_c)} WHEN {s} <= {lo} THEN {O.lit(lo_c)} ELSE {O.lit(t_c)} END AS action_color, "
        f"{reason} AS reason, {s} AS score, spend FROM tree WHERE level = 'creative' AND spend > 0 ORDER BY position LIMIT {C.RECOMMENDATION_CAP}"
    )


@register("recommendations", _recommend_sql())
def q_recommendations(spark, sf):
    r = funnel(spark, sf).recommendations
    return r.select("position", "creative", "campaign", "adset", "action", "action_color", "reason", "score", "spend")


def _digest_sql() -> str:
    kf = {c: c for c in [
        "total_spend", "total_revenue", "overall_roas", "overall_cpl", "overall_ctr", "total_leads",
        "total_appointments", "lead_to_appt_rate", "total_sales", "appt_to_sale_rate", "overall_cac",
    ]}
    summary = " UNION ALL ".join(
        f"SELECT 'summary' AS section, {i + 1} AS position, {O.render(t, kf)} AS text FROM kpis" for i, t in enumerate(C.DIGEST_SUMMARY_TEMPLATES)
    )
    cf = {c: c for c in ["name", "spend", "leads", "cpl", "ctr", "roas", "sales"]}
    cf["score"] = f"coalesce(CAST(performance_score AS VARCHAR), {O.lit(C.DIGEST_NONE)})"
    camps = (
        f"SELECT * FROM (SELECT 'campaigns' AS section, row_number() OVER (ORDER BY campaign_key) AS position, "
        f"{O.render(C.DIGEST_CAMPAIGN_TEMPLATE, cf)} AS text FROM tree WHERE level = 'campaign') WHERE position <= {C.DIGEST_CAMPAIGNS}"
    )
    none = (
        f"SELECT 'campaigns', 1, {O.lit(C.DIGEST_NO_CAMPAIGNS)} WHERE (SELECT count(*) FROM tree WHERE level = 'campaign') = 0"
    )
    rf = {"name": "name", "cpl": "cpl", "score": "performance_score"}
    top = (
        f"SELECT 'top', 1, coalesce(string_agg({O.render(C.DIGEST_TOP_TEMPLATE, rf)}, ', ' ORDER BY rk), {O.lit(C.DIGEST_NONE)}) FROM "
        f"(SELECT *, row_number() OVER (ORDER BY performance_score DESC, first_campaign_key, first_adset_key, first_creative_key) AS rk "
        f"FROM cons_creative WHERE depth = 0) WHERE rk <= {C.RANKING_SIZE}"
    )
    bottom = (
        f"SELECT 'bottom', 1, coalesce(string_agg({O.render(C.DIGEST_BOTTOM_TEMPLATE, rf)}, ', ' ORDER BY rk), {O.lit(C.DIGEST_NONE)}) FROM "
        f"(SELECT *, row_number() OVER (ORDER BY performance_score ASC, first_campaign_key DESC, first_adset_key DESC, first_creative_key DESC) AS rk "
        f"FROM cons_creative WHERE depth = 0) WHERE rk <= {C.RANKING_SIZE}"
    )
    return _sql(
        f"SELECT section, CAST(position AS BIGINT) AS position, text FROM ({summary} UNION ALL {camps} UNION ALL {none} UNION ALL {top} UNION ALL {bottom})"
    )


@register("digest_lines", _digest_sql())
def q_digest_lines(spark, sf):
    d = funnel(spark, sf).digest
    return d.select("section", F.col("position").cast("long").alias("position"), "text")


def _classes_sql() -> str:
    avg = "(SELECT overall_cpl FROM kpis)"
    return _sql(
        f"""SELECT level, id, name,
          CASE WHEN cpl = 0 THEN '' WHEN cpl < {avg} * {C.CPL_GOOD_FACTOR} THEN 'good' WHEN cpl > {avg} * {C.CPL_BAD_FACTOR} THEN 'bad' ELSE '' END AS cpl_class,
          CASE WHEN ctr = 0 THEN '' WHEN ctr >= {C.CTR_GOOD} THEN 'good' WHEN ctr < {C.CTR_BAD} THEN 'bad' ELSE '' END AS ctr_class,
          CASE WHEN roas = 0 THEN '' WHEN roas >= {C.ROAS_GOOD} THEN 'good' WHEN roas < {C.ROAS_BAD} THEN 'bad' ELSE '' END AS roas_class,
          CASE WHEN roas > 0 THEN roas END AS roas_shown, CASE WHEN cac > 0 THEN cac END AS cac_shown
        FROM tree"""
    )


@register("metric_classes", _classes_sql())
def q_metric_classes(spark, sf):
    f = funnel(spark, sf)
    return f.metric_classes


@register(
    "kpi_roas_class",
    _sql(f"SELECT overall_roas, CASE WHEN overall_roas >= {C.KPI_ROAS_GOOD} THEN 'green' WHEN overall_roas < {C.KPI_ROAS_BAD} THEN 'red' ELSE '' END AS roas_class FROM kpis"),
)
def q_kpi_roas_class(spark, sf):
    return RL.kpi_roas_class(funnel(spark, sf).kpis)


# ---------------------------------------------------------------------------
# Text ingest: the all-text ("bronze") rendering parsed back
# ---------------------------------------------------------------------------

def _bronze_sql_ctes() -> str:
    v = "l_linenumber % 4"
    date = (
        f"CASE WHEN {v} = 0 THEN strftime(date, '%Y-%m-%d') WHEN {v} = 1 THEN strftime(date, '%-d/%-m/%Y') "
        f"WHEN {v} = 2 THEN strftime(date, '%d/%m/%Y %H:%M:%S') ELSE '''' || strftime(date, '%d-%m-%Y') || '''' END"
    )
    us = "format('{:,.4f}', CAST(spend AS DOUBLE))"
    br = f"translate({us}, ',.', '.,')"
    money = f"CASE WHEN {v} = 0 THEN replace({us}, ',', '') WHEN {v} = 1 THEN {us} WHEN {v} = 2 THEN {br} ELSE 'R$ ' || {br} END"

    def k(x: str) -> str:
        return f"CASE WHEN {v} = 0 THEN {x} WHEN {v} = 1 THEN upper({x}) WHEN {v} = 2 THEN '  ' || {x} || ' ' ELSE {x} || chr(9) END"

    return (
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {date} AS date_text, {k('campaign')} AS campaign_text, "
        f"{k('adset')} AS adset_text, {k('creative')} AS creative_text, {money} AS spend_text, "
        f"CAST(CAST(trunc(impressions) AS BIGINT) AS VARCHAR) AS impressions_text, CAST(CAST(trunc(clicks) AS BIGINT) AS VARCHAR) AS clicks_text, "
        f"CAST(CAST(trunc(reach) AS BIGINT) AS VARCHAR) AS reach_text FROM f_ads"
    )


def _parse_date_sql(x: str) -> str:
    cleaned = f"regexp_replace({O.strip(x)}, '^[''\"]+|[''\"]+$', '', 'g')"
    return "coalesce(" + ", ".join(f"try_strptime({cleaned}, '{duck}')" for _, duck in C.DATE_FORMATS) + ")"


def _number_sql(x: str, target: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9,.]', '', 'g')"
    val = f"CASE WHEN regexp_matches({kept}, ',[^.]*$') THEN replace(replace({kept}, '.', ''), ',', '.') ELSE replace({kept}, ',', '') END"
    return f"coalesce(TRY_CAST({val} AS {target}), CAST(0 AS {target}))"


def _bronze_sql(body: str) -> str:
    return _sql(f", bronze_ads AS ({_bronze_sql_ctes()})\n" + body)


def _bronze_ads(spark, sf):
    return FX.bronze_tables(spark, sf).ads


@register(
    "parse_dates",
    _bronze_sql(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_text, {_parse_date_sql('date_text')} AS date FROM bronze_ads"),
)
def q_parse_dates(spark, sf):
    b = _bronze_ads(spark, sf)
    return b.select(*_ord_cols(), F.col("Date").alias("date_text"), parse_date(F.col("Date")).alias("date"))


@register(
    "parse_number",
    _bronze_sql(
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, spend_text, "
        f"CAST({_number_sql('spend_text', 'DECIMAL(38,6)')} AS DOUBLE) AS spend, {_number_sql('spend_text', 'DOUBLE')} AS spend_number, "
        f"{_number_sql('impressions_text', 'DOUBLE')} AS impressions FROM bronze_ads"
    ),
)
def q_parse_number(spark, sf):
    b = _bronze_ads(spark, sf)
    s = F.col("`Spend (Cost, Amount Spent)`")
    return b.select(
        *_ord_cols(), s.alias("spend_text"), parse_money(s).cast("double").alias("spend"),
        parse_number(s).alias("spend_number"), parse_number(F.col("Impressions")).alias("impressions"),
    )


@register(
    "normalize_keys",
    _bronze_sql(
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {O.key('campaign_text')} AS campaign_key, "
        f"{O.key('adset_text')} AS adset_key, {O.key('creative_text')} AS creative_key FROM bronze_ads"
    ),
)
def q_normalize_keys(spark, sf):
    b = _bronze_ads(spark, sf)
    return b.select(
        *_ord_cols(), norm_key(F.col("`Campaign Name`")).alias("campaign_key"),
        norm_key(F.col("`Ad Set Name`")).alias("adset_key"), norm_key(F.col("`Ad Name`")).alias("creative_key"),
    )


@register(
    "resolve_columns",
    _bronze_sql(
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_parse_date_sql('date_text')} AS date, campaign_text AS campaign, "
        f"adset_text AS adset, creative_text AS creative, CAST({_number_sql('spend_text', 'DECIMAL(38,6)')} AS DOUBLE) AS spend, "
        f"{_number_sql('impressions_text', 'DOUBLE')} AS impressions, {_number_sql('clicks_text', 'DOUBLE')} AS clicks, "
        f"{_number_sql('reach_text', 'DOUBLE')} AS reach FROM bronze_ads"
    ),
)
def q_resolve_columns(spark, sf):
    """S2 + S4: sheet headers normalised, resolved by alias, then typed."""
    bronze = FX.bronze_tables(spark, sf)
    raw = {n: IN.normalize_headers(getattr(bronze, n), keep=["ordinal", "row_order"]) for n in ("ads", "leads", "appointments", "sales")}
    silver, _ = IN.to_silver(raw, keep=["ordinal"])
    a = silver.ads
    return a.select(
        *_ord_cols(), "date", "campaign", "adset", "creative", F.col("spend").cast("double").alias("spend"),
        "impressions", "clicks", "reach",
    )


@register(
    "dedupe_columns",
    _sql(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {O.key('email')} AS email, {O.key('campaign')} AS campaign_key FROM f_appts"),
)
def q_dedupe_columns(spark, sf):
    """S3: a repeated header (' EMAIL ') and a blank one are dropped; the first wins."""
    a = FX.bronze_tables(spark, sf).appointments
    messy = a.select(
        "ordinal", "Email", "utm_campaign", F.lit("junk@example.invalid").alias(" EMAIL "), F.lit("x").alias(" "),
    )
    n = IN.normalize_headers(messy, keep=["ordinal"])
    return n.select(*_ord_cols(), norm_key("email").alias("email"), norm_key("utm_campaign").alias("campaign_key"))


@register(
    "load_raw",
    _bronze_sql(
        "SELECT 'ads' AS \"table\", count(*) AS \"rows\", CAST(sum(" + _number_sql("spend_text", "DECIMAL(38,6)") + ") AS DOUBLE) AS amount FROM bronze_ads "
        "UNION ALL SELECT 'leads', count(*), 0.0 FROM f_leads UNION ALL SELECT 'appointments', count(*), 0.0 FROM f_appts "
        "UNION ALL SELECT 'sales', count(*), CAST(sum(revenue) AS DOUBLE) FROM f_sales"
    ),
)
def q_load_raw(spark, sf):
    """The four text tables as files with different header orders, read
    back, resolved by alias and typed."""
    silver, _ = IN.to_silver(IN.load_raw(spark, FX.exported_csv(spark, sf)))
    parts = []
    for name, df in silver.as_dict().items():
        amount = {"ads": F.sum("spend"), "sales": F.sum("revenue")}.get(name)
        agg = df.agg(F.count(F.lit(1)).alias("rows"), (amount.cast("double") if amount is not None else F.lit(0.0)).alias("amount"))
        parts.append(agg.select(F.lit(name).alias("table"), "rows", "amount"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _file_names_sql() -> str:
    v = "l_linenumber % 4"

    def k(x: str) -> str:
        return f"CASE WHEN {v} = 0 THEN {x} WHEN {v} = 1 THEN upper({x}) WHEN {v} = 2 THEN '  ' || {x} || ' ' ELSE {x} || chr(9) END"

    first = lambda x: f"arg_min({O.strip(x)}, struct_pack(o := o, c := c, a := a, r := r))"
    none = "CAST(NULL AS VARCHAR)"
    return _sql(
        f", named AS (SELECT row_order AS o, {k('campaign')} AS c, {k('adset')} AS a, {k('creative')} AS r FROM ads_f)\n"
        f"SELECT 'campaign' AS level, {O.key('c')} AS campaign_key, {none} AS adset_key, {none} AS creative_key, {first('c')} AS name FROM named GROUP BY 2 "
        f"UNION ALL SELECT 'adset', {O.key('c')}, {O.key('a')}, {none}, {first('a')} FROM named GROUP BY 2, 3 "
        f"UNION ALL SELECT 'creative', {O.key('c')}, {O.key('a')}, {O.key('r')}, {first('r')} FROM named GROUP BY 2, 3, 4"
    )


@register("file_display_names", _file_names_sql())
def q_file_display_names(spark, sf):
    """A5 on files: the first spelling by file and place in it, over several files and splits."""
    silver, res = IN.to_silver(IN.load_raw(spark, FX.exported_csv(spark, sf)))
    return Funnel(silver, FX.FIXTURE_CONFIG, resolution=res, materialize=True).rollup.select("level", *RU.KEYS, "name")


_LEADS_HEADERS = ["data_padrão", "qual_é_o_e-mail_você_mais_utiliza?", "utm_campaign", "utm_medium", "utm_content"]


def _bronze_leads_sql() -> str:
    v = "l_linenumber % 4"
    date = (
        f"CASE WHEN {v} = 0 THEN strftime(date, '%Y-%m-%d') WHEN {v} = 1 THEN strftime(date, '%-d/%-m/%Y') "
        f"WHEN {v} = 2 THEN strftime(date, '%d/%m/%Y %H:%M:%S') ELSE chr(39) || strftime(date, '%d-%m-%Y') || chr(39) END"
    )

    def k(x: str) -> str:
        return f"CASE WHEN {v} = 0 THEN {x} WHEN {v} = 1 THEN upper({x}) WHEN {v} = 2 THEN '  ' || {x} || ' ' ELSE {x} || chr(9) END"

    return (
        f'SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {date} AS "data_padrão", '
        f'{k("email")} AS "qual_é_o_e-mail_você_mais_utiliza?", '
        f"{k('campaign')} AS utm_campaign, {k('adset')} AS utm_medium, {k('creative')} AS utm_content FROM f_leads"
    )


@register("normalize_headers", _sql(f", bronze_leads AS ({_bronze_leads_sql()})\nSELECT * FROM bronze_leads"))
def q_normalize_headers(spark, sf):
    """Sheet headers stripped, lower-cased, spaces -> '_' (values untouched)."""
    n = IN.normalize_headers(FX.bronze_tables(spark, sf).leads, keep=["ordinal"])
    return n.select(*_ord_cols(), *[F.col(f"`{h}`") for h in _LEADS_HEADERS])


def _date_audit_sql() -> str:
    col = '"data_padrão"'
    raw = f"regexp_replace({O.strip(col)}, '^[''\"]+|[''\"]+$', '', 'g')"
    keyword = f"coalesce(contains(upper(utm_campaign), '{FX.FIXTURE_CONFIG.leads_keyword}'), false)"
    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return _sql(
        f", bronze_leads AS ({_bronze_leads_sql()}), "
        f"failing AS (SELECT {order}, {raw} AS raw FROM bronze_leads WHERE {keyword} AND {_parse_date_sql(col)} IS NULL)\n"
        f"SELECT (SELECT count(*) FROM failing) AS null_dates, "
        f"(SELECT coalesce(list(raw ORDER BY {order}), []) FROM (SELECT * FROM failing ORDER BY {order} LIMIT 5)) AS failing_samples"
    )


@register("date_audit", _date_audit_sql())
def q_date_audit(spark, sf):
    """Unparsable lead dates after the keyword filter, with the first
    five failing raw texts (row order)."""
    b = IN.normalize_headers(FX.bronze_tables(spark, sf).leads, keep=["ordinal"])
    b = b.withColumn("campaign", F.col("utm_campaign"))
    out = Q.date_audit(b, "data_padrão", FX.FIXTURE_CONFIG)
    return out.select(F.col("null_dates").cast("long").alias("null_dates"), "failing_samples")


def _mixed_date_sql() -> str:
    line = "l_linenumber"
    v = f"{line} % 4"
    return (
        f"CASE WHEN {line} = 5 THEN strftime(date, '%Y/%m/%d') WHEN {line} = 6 THEN strftime(date, '%b %-d, %Y') WHEN {line} = 7 THEN 'n/a' "
        f"WHEN {v} = 0 THEN strftime(date, '%Y-%m-%d') WHEN {v} = 1 THEN strftime(date, '%-d/%-m/%Y') "
        f"WHEN {v} = 2 THEN strftime(date, '%d/%m/%Y %H:%M:%S') ELSE chr(39) || strftime(date, '%d-%m-%Y') || chr(39) END"
    )


def _guess_sql() -> str:
    formats = [duck for _, duck in C.GUESS_FORMATS]
    row = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    votes = " UNION ALL ".join(f"SELECT {k} AS k, count(try_strptime(cleaned, '{d}')) AS n FROM sheet WHERE date IS NULL" for k, d in enumerate(formats))
    read = " ".join(f"WHEN {k} THEN try_strptime(cleaned, '{d}')" for k, d in enumerate(formats))
    return _sql(
        f", typed AS (SELECT {row}, {_mixed_date_sql()} AS x FROM f_leads), "
        f"sheet AS (SELECT {row}, x, regexp_replace({O.strip('x')}, '^[''\"]+|[''\"]+$', '', 'g') AS cleaned, {_parse_date_sql('x')} AS date FROM typed), "
        f"vote AS (SELECT (SELECT k FROM ({votes}) WHERE n > 0 ORDER BY n DESC, k LIMIT 1) AS k)\n"
        f"SELECT {row}, x AS date_text, coalesce(date, CASE vote.k {read} END) AS date FROM sheet, vote"
    )


@register("parse_dates_guessed", _guess_sql())
def q_parse_dates_guessed(spark, sf):
    """C1 with the column's own guess: texts that the cascade leaves are read
    by the format that most of them have, whatever their order."""
    sheet = FX.mixed_lead_dates(spark, sf).select(*_ord_cols(), F.col("`Data Padrão`").alias("date_text"), F.col("`Data Padrão`").alias("date"))
    return guess_dates(sheet, ["date"])


def _mixed_audit_sql() -> str:
    row = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    keyword = f"coalesce(contains(upper(campaign), '{FX.FIXTURE_CONFIG.leads_keyword}'), false)"
    return _sql(
        f", typed AS (SELECT {row}, {_mixed_date_sql()} AS x FROM f_leads WHERE {keyword}), failing AS (SELECT * FROM typed WHERE {_parse_date_sql('x')} IS NULL)\n"
        f"SELECT (SELECT count(*) FROM failing) AS null_dates, (SELECT list(x ORDER BY {row}) FROM (SELECT * FROM failing ORDER BY {row} LIMIT 5)) AS failing_samples"
    )


@register("date_audit_mixed", _mixed_audit_sql())
def q_date_audit_mixed(spark, sf):
    """D2 on a sheet with dates that the cascade can't read."""
    b = IN.normalize_headers(FX.mixed_lead_dates(spark, sf), keep=["ordinal"]).withColumn("campaign", F.col("utm_campaign"))
    out = Q.date_audit(b, "data_padrão", FX.FIXTURE_CONFIG)
    return out.select(F.col("null_dates").cast("long").alias("null_dates"), "failing_samples")


def _crm_sql() -> str:
    row = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    none = "CAST(NULL AS VARCHAR)"
    parts = {
        "leads": ("f_leads", O.key("adset"), O.key("creative"), "CAST(NULL AS DOUBLE)", none, none),
        "appointments": ("f_appts", none, none, "CAST(NULL AS DOUBLE)", none, none),
        "sales": ("f_sales", none, none, "CAST(revenue AS DOUBLE)", "product", "origin"),
    }
    return _sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"table\", {row}, date, {O.key('email')} AS email, {O.key('campaign')} AS campaign_key, {a} AS adset_key, {r} AS creative_key, "
            f"{amount} AS revenue, {product} AS product, {origin} AS origin FROM {src}"
            for name, (src, a, r, amount, product, origin) in parts.items()
        )
    )


@register("resolve_columns_crm", _crm_sql())
def q_resolve_columns_crm(spark, sf):
    """S2 + S4 on leads, appointments and sales, each by its own aliases."""
    bronze = FX.bronze_tables(spark, sf)
    raw = {n: IN.normalize_headers(df, keep=["ordinal", "row_order"]) for n, df in bronze.as_dict().items()}
    silver, res = IN.to_silver(raw, keep=["ordinal"])
    out = []
    for name in ("leads", "appointments", "sales"):
        df = getattr(silver, name)

        def col(canon, expr, name=name, df=df):
            return expr if res.has(name, canon) else F.lit(None)

        out.append(
            df.select(
                F.lit(name).alias("table"), *_ord_cols(), "date", norm_key("email").alias("email"), norm_key("campaign").alias("campaign_key"),
                col("adset", norm_key("adset") if "adset" in df.columns else None).cast("string").alias("adset_key"),
                col("creative", norm_key("creative") if "creative" in df.columns else None).cast("string").alias("creative_key"),
                col("revenue", F.col("revenue") if "revenue" in df.columns else None).cast("double").alias("revenue"),
                col("product", F.col("product") if "product" in df.columns else None).cast("string").alias("product"),
                col("origin", F.col("origin") if "origin" in df.columns else None).cast("string").alias("origin"),
            )
        )
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("bronze_kpis", _sql("SELECT * FROM kpis"))
def q_bronze_kpis(spark, sf):
    """The whole funnel from the text tables: parsing is lossless, so the
    KPIs equal those of the typed tables."""
    b = FX.bronze_tables(spark, sf)
    raw = {n: IN.normalize_headers(d, keep=["ordinal", "row_order"]) for n, d in b.as_dict().items()}
    silver, res = IN.to_silver(raw)
    return Funnel(silver, FX.FIXTURE_CONFIG, resolution=res, materialize=True).kpis


@register(
    "empty_payload",
    "SELECT 0.0 AS total_spend, 0.0 AS total_revenue, 0.0 AS overall_roas, 0.0 AS overall_cpl, 0.0 AS overall_ctr, "
    "CAST(0 AS BIGINT) AS total_leads, CAST(0 AS BIGINT) AS total_appointments, CAST(0 AS BIGINT) AS total_sales, "
    "0.0 AS overall_cac, 0.0 AS lead_to_appt_rate, 0.0 AS appt_to_sale_rate, 0.0 AS overall_cpm, CAST(0 AS BIGINT) AS total_reach, "
    "0.0 AS overall_frequency, 0.0 AS overall_connect_rate, 0.0 AS overall_page_cvr, CAST(0 AS BIGINT) AS tree_rows",
)
def q_empty_payload(spark, sf):
    """Ads without a resolvable campaign column -> zero KPIs, empty tree."""
    t = FX.silver_tables(spark, sf)
    ads = t.ads.withColumnRenamed("campaign", "campaign_label")
    f = Funnel(FX.FunnelTables(ads, t.leads, t.appointments, t.sales), FX.FIXTURE_CONFIG)
    return f.kpis.crossJoin(f.tree.agg(F.count(F.lit(1)).alias("tree_rows")))


@register(
    "payload_runs",
    _sql(
        "SELECT 'full' AS run, kpis.*, (SELECT count(*) FROM tree) AS tree_rows FROM kpis UNION ALL BY NAME "
        "SELECT 'empty' AS run, COLUMNS(*) * 0 FROM (SELECT *, (SELECT count(*) FROM tree) AS tree_rows FROM kpis)"
    ),
)
def q_payload_runs(spark, sf):
    """S6 beside a whole run: the same tables with and without a campaign column of the ads."""
    t = FX.silver_tables(spark, sf)
    runs = {"full": t, "empty": FX.FunnelTables(t.ads.withColumnRenamed("campaign", "campaign_label"), t.leads, t.appointments, t.sales)}
    rows = []
    for name, tables in runs.items():
        f = Funnel(tables, FX.FIXTURE_CONFIG, materialize=True)
        rows.append(f.kpis.crossJoin(f.tree.agg(F.count(F.lit(1)).alias("tree_rows"))).select(F.lit(name).alias("run"), "*"))
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------------------
# Export and refresh (rows-only checks)
# ---------------------------------------------------------------------------

@register("performance_nested", _sql(f"SELECT {_TREE_COLS}, performance_score, score_band FROM tree"))
def q_performance_nested(spark, sf):
    """H1: the nested export, in chunks of children, parsed back to the tree's rows."""
    from ..operators.hierarchy import nested_export, parsed_back

    return parsed_back(nested_export(funnel(spark, sf).tree)).select(*_cols(_TREE_COLS), "performance_score", "score_band")


@register("payload_export", None)
def q_payload_export(spark, sf):
    """The whole payload, one JSON row per record of each section."""
    return funnel(spark, sf).payload()


def _refreshed(spark, sf) -> str:
    """A work folder after two refreshes: half of the orders' rows land first, then the rest."""
    from ..session import checkpoint_dir
    from ..streaming.refresh import TABLES, start_refresh
    import uuid

    t = FX.silver_tables(spark, sf)
    work = f"{checkpoint_dir(spark)}/refresh-{uuid.uuid4().hex[:8]}"
    src = {n: f"{work}/source/{n}" for n in TABLES}
    tables = t.as_dict()
    schemas = {n: df.schema for n, df in tables.items()}
    for half in (0, 1):
        for n, df in tables.items():
            df.where(F.pmod(F.xxhash64("ordinal"), F.lit(2)) == half).write.mode("append").option("compression", "zstd").parquet(src[n])
        start_refresh(spark, src, schemas, work, FX.FIXTURE_CONFIG, available_now=True, buckets=8)
    return work


@register("refresh_stream", _sql(f"SELECT {_TREE_COLS}, performance_score, score_band FROM tree"))
def q_refresh_stream(spark, sf):
    """The four tables streamed in two halves; the tree published from
    the merged state equals the one over all rows."""
    from ..streaming.refresh import latest_snapshot

    tree = spark.read.parquet(f"{latest_snapshot(spark, _refreshed(spark, sf))}/performance_tree")
    return tree.select(*_cols(_TREE_COLS), "performance_score", "score_band")


@register("refresh_alerts", QUERIES["rule_alerts"][1])
def q_refresh_alerts(spark, sf):
    """The alerts that the insights stream made of the last snapshot."""
    from ..streaming.refresh import latest_insights

    alerts = spark.read.parquet(f"{latest_insights(spark, _refreshed(spark, sf)).insights}/rule_alerts")
    return alerts.select("position", "rule_no", "type", "icon", "level", "entity", "metric", "value", "message", "action")


@register(
    "freshness",
    _sql(
        "SELECT CAST(2 AS BIGINT) AS refreshes, true AS connected, false AS stale, true AS insights_ready, (SELECT count(*) FROM f_ads) AS ads_rows, "
        "(SELECT count(*) FROM f_leads) AS leads_rows, (SELECT count(*) FROM f_appts) AS appointments_rows, (SELECT count(*) FROM f_sales) AS sales_rows"
    ),
)
def q_freshness(spark, sf):
    """T4: health after two refreshes, with the rows taken in."""
    from ..streaming.refresh import TABLES, freshness

    work = _refreshed(spark, sf)
    out = freshness(spark, work).select("refreshes", "connected", "stale", "insights_ready")
    for n in TABLES:
        taken = spark.read.parquet(f"{work}/ingested/{n}").agg(F.sum("rows").alias(f"{n}_rows"))  # one row
        out = out.crossJoin(taken)
    return out


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}
