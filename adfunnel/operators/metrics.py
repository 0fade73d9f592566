"""Run-level figures: KPIs, funnel totals, date span.

Every result here is a one-row DataFrame built from one-row aggregates;
they are combined with cross joins of single rows (size bound: 1 row each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import MONEY, round2, safe_div

KPI_COLUMNS = [
    "total_spend", "total_revenue", "overall_roas", "overall_cpl", "overall_ctr",
    "total_leads", "total_appointments", "total_sales", "overall_cac",
    "lead_to_appt_rate", "appt_to_sale_rate", "overall_cpm", "total_reach",
    "overall_frequency", "overall_connect_rate", "overall_page_cvr",
]


def ads_totals(rollup: DataFrame) -> DataFrame:
    """A12 (and A4): unrounded run totals of the ads measures over campaigns."""
    camp = rollup.where(F.col("level") == "campaign")
    return camp.agg(
        F.coalesce(F.sum("spend_sum"), F.lit(0).cast(MONEY)).alias("spend"),
        F.coalesce(F.sum("impressions"), F.lit(0.0)).alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("clicks"),
        F.coalesce(F.sum("reach"), F.lit(0.0)).alias("reach"),
    )


def funnel_totals(level_facts: DataFrame, totals_level: str) -> DataFrame:
    """A6 + A7: the run-totals row carried by the level facts."""
    return level_facts.where(F.col("level") == totals_level).select(
        F.col("leads").alias("total_leads"),
        F.col("appointments").alias("total_appointments"),
        F.col("sales").alias("total_sales"),
        "revenue",
    )


def kpis(totals: DataFrame, funnel: DataFrame, ads_present: DataFrame | None = None) -> DataFrame:
    """The 16 KPIs.  ``ads_present`` is a one-row frame with a boolean
    ``ads_present``; when false every KPI is 0 (the empty payload)."""
    t = totals.crossJoin(funnel)
    spend = F.col("spend").cast("double")
    revenue = F.col("revenue").cast("double")
    imp, clicks, reach = F.col("impressions"), F.col("clicks"), F.col("reach")
    leads, appts, sales = F.col("total_leads"), F.col("total_appointments"), F.col("total_sales")
    cols = {
        "total_spend": round2(spend),
        "total_revenue": round2(revenue),
        "overall_roas": round2(safe_div(revenue, spend)),
        "overall_cpl": round2(safe_div(spend, leads)),
        "overall_ctr": round2(safe_div(clicks, imp) * 100),
        "total_leads": leads.cast("long"),
        "total_appointments": appts.cast("long"),
        "total_sales": sales.cast("long"),
        "overall_cac": round2(safe_div(spend, sales)),
        "lead_to_appt_rate": round2(safe_div(appts, leads) * 100),
        "appt_to_sale_rate": round2(safe_div(sales, appts) * 100),
        "overall_cpm": round2(safe_div(spend, imp) * 1000),
        "total_reach": reach.cast("long"),
        "overall_frequency": round2(safe_div(imp, reach)),
        "overall_connect_rate": round2(safe_div(clicks, reach) * 100),
        "overall_page_cvr": round2(safe_div(leads, clicks) * 100),
    }
    if ads_present is not None:
        t = t.crossJoin(ads_present)
        zero = lambda c: F.lit(0).cast("long") if c.startswith("total_") and c not in ("total_spend", "total_revenue") else F.lit(0.0)
        cols = {k: F.when(F.col("ads_present"), v).otherwise(zero(k)) for k, v in cols.items()}
    return t.select(*[v.alias(k) for k, v in cols.items()])


def ads_present(raw_ads: DataFrame) -> DataFrame:
    """One row: does the raw ads table have any row?  Reads at most one row
    per partition (local limit)."""
    return raw_ads.select(F.lit(1).alias("_one")).limit(1).agg((F.count("*") > 0).alias("ads_present"))


def date_span(rollup: DataFrame) -> DataFrame:
    """First and last day of the filtered ads, as yyyy-MM-dd text, from
    the stored roll-up (no second scan; the ads filter needs a campaign, so
    the campaign rows cover every row)."""
    return rollup.where(F.col("level") == "campaign").agg(
        F.date_format(F.min("first_date"), "yyyy-MM-dd").alias("date_start"),
        F.date_format(F.max("last_date"), "yyyy-MM-dd").alias("date_end"),
    )
