"""Data-quality tables (D1-D5) and campaign-key overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FunnelConfig
from ..functions.clean import norm_key, norm_upper, parse_date, strip_ws
from . import filters as FL


def _audit(df: DataFrame, table: str, steps: list[tuple[str, Column]]) -> DataFrame:
    """Row counts after each cumulative predicate, in one pass over ``df``."""
    aggs = [F.count(F.lit(1)).alias("s0")]
    cond: Column = F.lit(True)
    for i, (_, pred) in enumerate(steps, start=1):
        cond = cond & F.coalesce(pred, F.lit(False))
        aggs.append(F.count(F.when(cond, F.lit(1))).alias(f"s{i}"))
    counts = df.agg(*aggs)
    names = ["loaded"] + [n for n, _ in steps]
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"s{i}").cast("long").alias("rows")) for i, n in enumerate(names)])
    return counts.select(F.explode(rows).alias("r")).select(F.lit(table).alias("table"), "r.*")


def filter_audit(ads: DataFrame, leads: DataFrame, appts: DataFrame, sales: DataFrame, cfg: FunnelConfig) -> DataFrame:
    """Rows before / after each filter of each table."""
    parts = [
        _audit(ads, "ads", [("campaign keyword", FL.ads_keyword(cfg)), ("date range", FL.ads_in_range(cfg))]),
        _audit(leads, "leads", [("campaign keyword", FL.leads_keyword(cfg)), ("date range", FL.day_in_range(cfg))]),
        _audit(appts, "appointments", [("campaign present", FL.appointment_has_campaign()), ("date range", FL.day_in_range(cfg))]),
        _audit(
            sales,
            "sales",
            [
                ("product", norm_upper("product") == cfg.sales_product),
                ("origin", norm_upper("origin") == cfg.sales_origin),
                ("date range", FL.day_in_range(cfg)),
            ],
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_audit(raw_leads: DataFrame, date_col: str, cfg: FunnelConfig, samples: int = 5) -> DataFrame:
    """Unparsable lead dates after the keyword filter, with up to
    ``samples`` failing raw texts (first in row order)."""
    kw = FL.leads_keyword(cfg)
    t = raw_leads.where(kw).select(
        "ordinal",
        F.regexp_replace(strip_ws(F.col(f"`{date_col}`")), "^['\"]+|['\"]+$", "").alias("raw"),
        parse_date(F.col(f"`{date_col}`")).alias("parsed"),
    )
    failing = t.where(F.col("parsed").isNull())
    count = failing.agg(F.count(F.lit(1)).alias("null_dates"))
    first = failing.orderBy("ordinal").limit(samples).select(F.struct("ordinal", "raw").alias("s"))
    sample = first.agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        F.transform("s", lambda x: x["raw"]).alias("failing_samples")
    )
    return count.crossJoin(sample)


def campaign_match(tree: DataFrame) -> DataFrame:
    """Campaigns with any appointment or sale attributed."""
    return tree.where(
        (F.col("level") == "campaign") & ((F.col("appointments") > 0) | (F.col("sales") > 0))
    ).select("campaign_key", "name", "leads", "appointments", "sales", "revenue")


def distinct_keys(rows: DataFrame) -> DataFrame:
    """Campaign keys of ``rows``, each once (counted off in every map task first)."""
    return rows.select(norm_key("campaign").alias("campaign_key")).where("campaign_key is not null").distinct()


def campaign_keys(ads: DataFrame, appts: DataFrame, sales: DataFrame) -> DataFrame:
    """The distinct campaign keys of each table (as the log listings); blank ones of sales are left out."""
    parts = {"ads": ads, "appointments": appts, "sales": sales.where(F.col("campaign_key") != "")}
    return reduce(DataFrame.unionByName, [keys.select(F.lit(name).alias("table"), "campaign_key") for name, keys in parts.items()])


def key_overlap(left: DataFrame, ads: DataFrame) -> DataFrame:
    """Campaign keys present in both; the two sides hold each key once."""
    return left.join(ads, "campaign_key", "left_semi")
