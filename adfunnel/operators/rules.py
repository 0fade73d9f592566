"""Rule alerts, recommendations, digest and display classes.

Rules are evaluated per tree row as an array of optional structs, exploded
once (no union of six scans).  "Keep the first alert per (entity, metric)
in depth-first order" is a window partitioned by (entity, metric); the cap
is a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import render

def _dfs() -> list[Column]:
    """Depth-first tree order: parent first, children by key."""
    return [
        F.col("campaign_key").asc(),
        F.col("adset_key").asc_nulls_first(),
        F.col("creative_key").asc_nulls_first(),
    ]


def _score() -> Column:
    return F.coalesce(F.col("performance_score"), F.lit(C.DEFAULT_MISSING_SCORE))


def _rule_conditions(avg_cpl: Column) -> dict[int, Column]:
    ctr, cvr, cpl, roas = F.col("ctr"), F.col("conversion_rate"), F.col("cpl"), F.col("roas")
    spend, level = F.col("spend"), F.col("level")
    spent = spend > 0
    return {
        1: (ctr > 0) & (ctr < C.LOW_CTR) & spent,
        2: (ctr > C.LP_CTR) & (cvr < C.LP_CVR) & spent & (cvr > 0),
        3: (avg_cpl > 0) & (cpl > avg_cpl * C.CPL_FACTOR) & spent,
        4: (F.col("leads") > C.APPT_MIN_LEADS) & (F.col("appointment_rate") < C.APPT_RATE) & (level == "campaign"),
        5: (_score() >= C.SCALE_SCORE) & spent & (level == "creative"),
        6: (roas > 0) & (roas < C.BREAKEVEN_ROAS) & spent,
    }


def _fields(avg_cpl: Column) -> dict[str, Column]:
    excess = F.when(avg_cpl > 0, (F.col("cpl") / avg_cpl - 1) * 100).otherwise(F.lit(0.0))
    return {
        "ctr": F.col("ctr"), "conversion_rate": F.col("conversion_rate"), "cpl": F.col("cpl"),
        "roas": F.col("roas"), "appointment_rate": F.col("appointment_rate"), "score": _score(),
        "level": F.col("level"), "name": F.col("name"), "cpl_excess_pct": excess,
    }


def alert_candidates(tree: DataFrame, kpis: DataFrame) -> DataFrame:
    """Every rule firing on every tree row, before de-duplication."""
    t = tree.crossJoin(F.broadcast(kpis.select(F.col("overall_cpl").alias("_avg_cpl"))))
    avg = F.col("_avg_cpl")
    conds, fields = _rule_conditions(avg), _fields(avg)
    structs = []
    for rule_no, kind, icon, metric, action in C.ALERT_RULES:
        s = F.struct(
            F.lit(rule_no).alias("rule_no"),
            F.lit(kind).alias("type"),
            F.lit(icon).alias("icon"),
            F.lit(metric).alias("metric"),
            render(C.ALERT_VALUE_TEMPLATES[rule_no], fields).alias("value"),
            render(C.ALERT_MESSAGE_TEMPLATES[rule_no], fields).alias("message"),
            F.lit(action).alias("action"),
        )
        structs.append(F.when(conds[rule_no], s))
    fired = F.filter(F.array(*structs), lambda x: x.isNotNull())
    return t.select(
        "level", "campaign_key", "adset_key", "creative_key", F.col("name").alias("entity"),
        F.explode(fired).alias("a"),
    ).select("level", "campaign_key", "adset_key", "creative_key", "entity", "a.*")


def rule_alerts(tree: DataFrame, kpis: DataFrame, cap: int = C.ALERT_CAP) -> DataFrame:
    """First alert per (entity, metric) in depth-first order, at most ``cap``."""
    t = tree.crossJoin(F.broadcast(kpis.select(F.col("overall_cpl").alias("_avg_cpl"))))
    conds = _rule_conditions(F.col("_avg_cpl"))
    fired = F.filter(F.array(*(F.when(conds[r[0]], F.lit(r[0])) for r in C.ALERT_RULES)), lambda x: x.isNotNull())
    fired = t.select("*", F.explode(fired).alias("rule_no"))
    metric = F.element_at(F.create_map(*(F.lit(x) for r in C.ALERT_RULES for x in (r[0], r[3]))), F.col("rule_no"))
    # the least row per entity and metric, found before any shuffle as far as it can be; texts are made for the rows that are left
    order = _dfs() + [F.col("rule_no").asc()]
    least = F.min(F.struct("campaign_key", "adset_key", "creative_key", "rule_no", F.struct(*t.columns).alias("row"))).alias("m")
    first = fired.groupBy(F.col("name").alias("entity"), metric.alias("metric")).agg(least).select("m.row.*", "m.rule_no", "entity", "metric")
    top = first.orderBy(*order).limit(cap)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    fields = _fields(F.col("_avg_cpl"))
    pick = lambda text: F.coalesce(*(F.when(F.col("rule_no") == r[0], text(r)) for r in C.ALERT_RULES))
    return top.select(
        "position", "rule_no", pick(lambda r: F.lit(r[1])).alias("type"), pick(lambda r: F.lit(r[2])).alias("icon"), "level", "entity", "metric",
        pick(lambda r: render(C.ALERT_VALUE_TEMPLATES[r[0]], fields)).alias("value"), pick(lambda r: render(C.ALERT_MESSAGE_TEMPLATES[r[0]], fields)).alias("message"),
        pick(lambda r: F.lit(r[4])).alias("action"), "campaign_key", "adset_key", "creative_key",
    )


def recommendations(tree: DataFrame, cap: int = C.RECOMMENDATION_CAP) -> DataFrame:
    """I8: creatives with spend: scale / pause / test by score, best first."""
    s = _score()
    hi, hi_action, hi_colour = C.RECOMMEND_SCALE
    lo, lo_action, lo_colour = C.RECOMMEND_PAUSE
    test_action, test_colour = C.RECOMMEND_TEST
    action = F.when(s >= hi, F.lit(hi_action)).when(s <= lo, F.lit(lo_action)).otherwise(F.lit(test_action))
    colour = F.when(s >= hi, F.lit(hi_colour)).when(s <= lo, F.lit(lo_colour)).otherwise(F.lit(test_colour))
    fields = {"score": s, "cpl": F.col("cpl")}
    reason = (
        F.when(s >= hi, render(C.RECOMMEND_REASON_TEMPLATES[hi_action], fields))
        .when(s <= lo, render(C.RECOMMEND_REASON_TEMPLATES[lo_action], fields))
        .otherwise(render(C.RECOMMEND_REASON_TEMPLATES[test_action], fields))
    )
    rows = tree.where((F.col("level") == "creative") & (F.col("spend") > 0)).select(
        F.col("name").alias("creative"),
        F.coalesce(F.col("campaign_name"), F.lit("")).alias("campaign"),
        F.coalesce(F.col("adset_name"), F.lit("")).alias("adset"),
        action.alias("action"),
        colour.alias("action_color"),
        reason.alias("reason"),
        s.alias("score"),
        "spend", "campaign_key", "adset_key", "creative_key",
    )
    order = [F.col("score").desc()] + _dfs()
    top = rows.orderBy(*order).limit(cap)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def digest_lines(tree: DataFrame, kpis: DataFrame, top: DataFrame, bottom: DataFrame) -> DataFrame:
    """The text digest as ordered lines (section, position, text).

    Only bounded inputs are gathered: one KPI row, the first
    ``DIGEST_CAMPAIGNS`` campaigns, and the two five-row rankings.
    """
    kfields = {c: F.col(c) for c in kpis.columns}
    summary = kpis.select(
        F.explode(
            F.array(*[F.struct(F.lit(i + 1).alias("position"), render(t, kfields).alias("text")) for i, t in enumerate(C.DIGEST_SUMMARY_TEMPLATES)])
        ).alias("l")
    ).select(F.lit("summary").alias("section"), "l.position", "l.text")

    camp = tree.where(F.col("level") == "campaign")
    cfields = {c: F.col(c) for c in ["name", "spend", "leads", "cpl", "ctr", "roas", "sales"]}
    cfields["score"] = F.coalesce(F.col("performance_score").cast("string"), F.lit(C.DIGEST_NONE))
    first = camp.orderBy("campaign_key").limit(C.DIGEST_CAMPAIGNS)
    camp_lines = first.select(
        F.lit("campaigns").alias("section"),
        F.row_number().over(Window.orderBy("campaign_key")).alias("position"),
        render(C.DIGEST_CAMPAIGN_TEMPLATE, cfields).alias("text"),
    )
    no_camp = (
        camp.agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == 0)
        .select(F.lit("campaigns").alias("section"), F.lit(1).alias("position"), F.lit(C.DIGEST_NO_CAMPAIGNS).alias("text"))
    )

    def joined(df: DataFrame, template: str, section: str) -> DataFrame:
        f = {"name": F.col("name"), "cpl": F.col("cpl"), "score": F.col("performance_score")}
        items = df.select(F.struct("rank", render(template, f).alias("t")).alias("i"))
        agg = items.agg(F.array_sort(F.collect_list("i")).alias("items"))
        text = F.when(F.size("items") > 0, F.array_join(F.transform("items", lambda x: x["t"]), ", ")).otherwise(
            F.lit(C.DIGEST_NONE)
        )
        return agg.select(F.lit(section).alias("section"), F.lit(1).alias("position"), text.alias("text"))

    out = summary.unionByName(camp_lines).unionByName(no_camp)
    return out.unionByName(joined(top, C.DIGEST_TOP_TEMPLATE, "top")).unionByName(
        joined(bottom, C.DIGEST_BOTTOM_TEMPLATE, "bottom")
    )


def metric_classes(tree: DataFrame, kpis: DataFrame) -> DataFrame:
    """P1 + P3: good / bad classes relative to thresholds and the overall CPL;
    ROAS and CAC are shown only when positive."""
    t = tree.crossJoin(F.broadcast(kpis.select(F.col("overall_cpl").alias("_avg_cpl"))))
    cpl, ctr, roas, cac, avg = F.col("cpl"), F.col("ctr"), F.col("roas"), F.col("cac"), F.col("_avg_cpl")
    cpl_cls = (
        F.when(cpl == 0, F.lit(""))
        .when(cpl < avg * C.CPL_GOOD_FACTOR, F.lit("good"))
        .when(cpl > avg * C.CPL_BAD_FACTOR, F.lit("bad"))
        .otherwise(F.lit(""))
    )
    ctr_cls = F.when(ctr == 0, F.lit("")).when(ctr >= C.CTR_GOOD, F.lit("good")).when(ctr < C.CTR_BAD, F.lit("bad")).otherwise(F.lit(""))
    roas_cls = F.when(roas == 0, F.lit("")).when(roas >= C.ROAS_GOOD, F.lit("good")).when(roas < C.ROAS_BAD, F.lit("bad")).otherwise(F.lit(""))
    return t.select(
        "level", "id", "name",
        cpl_cls.alias("cpl_class"), ctr_cls.alias("ctr_class"), roas_cls.alias("roas_class"),
        F.when(roas > 0, roas).alias("roas_shown"), F.when(cac > 0, cac).alias("cac_shown"),
    )


def kpi_roas_class(kpis: DataFrame) -> DataFrame:
    """Colour of the ROAS card."""
    r = F.col("overall_roas")
    cls = F.when(r >= C.KPI_ROAS_GOOD, F.lit("green")).when(r < C.KPI_ROAS_BAD, F.lit("red")).otherwise(F.lit(""))
    return kpis.select("overall_roas", cls.alias("roas_class"))
