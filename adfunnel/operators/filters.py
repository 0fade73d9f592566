"""Row filters of the funnel.

All predicates are plain column expressions so Catalyst can push the date
bounds into the scan when ``date`` is a stored column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FunnelConfig
from ..functions.clean import norm_upper, strip_ws


def ts_lit(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def ads_keyword(cfg: FunnelConfig) -> Column:
    """upper(campaign) contains the ads keyword (null campaign dropped)."""
    return F.coalesce(F.upper(F.col("campaign")).contains(cfg.ads_keyword), F.lit(False))


MONTH = "date_month"  # partition column of stored tables


def month_of(date: Column) -> Column:
    """Month that a row is stored under ('yyyy-MM'); null without a date."""
    return F.date_format(date, "yyyy-MM")


def in_months(rows: DataFrame, cfg: FunnelConfig) -> DataFrame:
    """Rows of the window's months: where ``rows`` is stored by month, no
    other month's files are opened. Rows without a date are in no window."""
    if MONTH not in rows.columns:
        return rows
    return rows.where(F.col(MONTH).between(month_of(ts_lit(cfg.date_start)), month_of(ts_lit(cfg.date_end)))).drop(MONTH)


def ads_in_range(cfg: FunnelConfig) -> Column:
    """start <= ts <= end, *without* day truncation of the end bound."""
    return (F.col("date") >= ts_lit(cfg.date_start)) & (F.col("date") <= ts_lit(cfg.date_end))


def day_in_range(cfg: FunnelConfig) -> Column:
    """start <= ts and day(ts) <= end, written as a sargable half-open range."""
    end_excl = F.date_add(F.lit(cfg.date_end).cast("date"), 1).cast("timestamp_ntz")
    return (F.col("date") >= ts_lit(cfg.date_start)) & (F.col("date") < end_excl)


def leads_keyword(cfg: FunnelConfig) -> Column:
    """upper(campaign) contains the leads keyword."""
    return F.coalesce(F.upper(F.col("campaign")).contains(cfg.leads_keyword), F.lit(False))


def appointment_has_campaign() -> Column:
    """trimmed campaign is not blank."""
    return F.coalesce(strip_ws(F.col("campaign")) != "", F.lit(False))


def filter_ads(ads: DataFrame, cfg: FunnelConfig, has_campaign: bool = True) -> DataFrame:
    if has_campaign:
        ads = ads.where(ads_keyword(cfg))
    return in_months(ads, cfg).where(ads_in_range(cfg))


def filter_leads(leads: DataFrame, cfg: FunnelConfig, has_date: bool = True) -> DataFrame:
    leads = leads.where(leads_keyword(cfg))
    return in_months(leads, cfg).where(day_in_range(cfg)) if has_date else leads


def filter_appointments(
    appts: DataFrame, cfg: FunnelConfig, has_campaign: bool = True, has_date: bool = True
) -> DataFrame:
    if has_campaign:
        appts = appts.where(appointment_has_campaign())
    return in_months(appts, cfg).where(day_in_range(cfg)) if has_date else appts


def filter_sales(
    sales: DataFrame,
    cfg: FunnelConfig,
    has_product: bool = True,
    has_origin: bool = True,
    has_date: bool = True,
) -> DataFrame:
    """F6 (segment equality, each only if the column exists) and F4."""
    if has_product:
        sales = sales.where(norm_upper("product") == cfg.sales_product)
    if has_origin:
        sales = sales.where(norm_upper("origin") == cfg.sales_origin)
    return in_months(sales, cfg).where(day_in_range(cfg)) if has_date else sales


def campaign_filter(tree: DataFrame, text: str | None) -> DataFrame:
    """F8: keep campaigns whose display name contains ``text`` (case-insensitive)
    and, through the campaign key, their whole subtree."""
    if not text:
        return tree
    roots = tree.where((F.col("level") == "campaign") & F.lower("name").contains(text.lower())).select(
        "campaign_key"
    )
    return tree.join(roots, "campaign_key", "left_semi")


def table_search(rows: DataFrame, text: str | None, level: str = "all") -> DataFrame:
    """name contains ``text`` (case-insensitive) and level matches."""
    out = rows
    if level != "all":
        out = out.where(F.col("level") == level)
    if text:
        out = out.where(F.lower("name").contains(text.lower()))
    return out
