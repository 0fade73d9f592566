"""Ads roll-up, e-mail attribution and the performance tree.

Shapes at scale:

* ads: one GROUPING SETS aggregate ((c), (c,a), (c,a,r)) -> Expand + partial
  aggregation before the shuffle, so a campaign holding a third of all rows
  costs no more than any other.
* leads: (keys, e-mail) rows deduplicated (partial distinct on the map side),
  dealt by e-mail and repeated per level there, then one equi-join on e-mail
  with a per-e-mail outcome table (unique per e-mail, so there is no fan-out
  even for a hot e-mail such as '').
* campaign-level appointments/sales: COUNT(DISTINCT) by campaign, which Spark
  plans as a two-level aggregate keyed (campaign, e-mail) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import MONEY, norm_key, round2, safe_div, strip_ws

LEVELS = ("campaign", "adset", "creative")
KEYS = ["campaign_key", "adset_key", "creative_key"]
def _null_str() -> Column:
    return F.lit(None).cast("string")

# Ratio columns of every row, computed from its own totals.
RATIO_COLUMNS = ["ctr", "cpl", "cac", "roas", "conversion_rate", "appointment_rate", "close_rate"]


def keyed_ads(ads_f: DataFrame, has_adset: bool, has_creative: bool, has_order: bool) -> DataFrame:
    """Display names (stripped) and keys (stripped + lower) of the ads rows.

    ``row_order`` (a long: the position of the row in its source) decides
    which spelling of a key is shown; without it the least spelling is.
    """
    c_name = strip_ws("campaign")
    a_name = strip_ws("adset") if has_adset else _null_str()
    r_name = strip_ws("creative") if has_creative else _null_str()
    order = F.col("row_order").cast("long") if has_order else F.lit(None).cast("long")
    return ads_f.select(
        order.alias("_ord"),
        c_name.alias("c_name"),
        F.lower(c_name).alias("campaign_key"),
        a_name.alias("a_name"),
        F.lower(a_name).alias("adset_key"),
        r_name.alias("r_name"),
        F.lower(r_name).alias("creative_key"),
        F.col("spend").cast(MONEY).alias("spend"),
        F.col("impressions").cast("double").alias("impressions"),
        F.col("clicks").cast("double").alias("clicks"),
        F.col("reach").cast("double").alias("reach"),
        F.col("date").alias("_date") if "date" in ads_f.columns else F.lit(None).cast("timestamp_ntz").alias("_date"),
    )


def _first(name: str) -> Column:
    """First spelling: least (row order, spelling) of the group."""
    return F.min_by(name, F.struct("_ord", name))


SPELLINGS = ["c_name", "a_name", "r_name"]


def fine_ads(ads_k: DataFrame) -> DataFrame:
    """Phase 1 of the roll-up: one row per distinct (keys, spellings).

    It keeps only fixed-width buffers (sums, least and greatest of a long or a
    time), so it is a HashAggregate with map-side partial aggregation.
    """
    return merge_fine(ads_k.withColumns({"first_date": F.col("_date"), "last_date": F.col("_date")}))


def merge_fine(fine: DataFrame) -> DataFrame:
    """Rows of phase 1 from several sources as one: every measure merges."""
    return fine.groupBy(*KEYS, *SPELLINGS).agg(
        *(F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "reach")),
        F.min("_ord").alias("_ord"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def ads_rollup(ads_k: DataFrame, has_adset: bool, has_creative: bool) -> DataFrame:
    """A1-A3 + A5: all three levels in one plan: phase 1 over the raw rows, phase 2 over its small result."""
    return expand_rollup(fine_ads(ads_k), has_adset, has_creative)


def expand_rollup(fine: DataFrame, has_adset: bool, has_creative: bool) -> DataFrame:
    """Phase 2: the three grouping sets, with the first spelling per key.

    Output: level, campaign_key, adset_key, creative_key, name, spend_sum
    (exact decimal), impressions, clicks, reach (unrounded sums), first_date,
    last_date.  Groups with a null key at their own level are dropped, like a
    pandas group-by.
    """
    sets = [["campaign_key"]]
    if has_adset:
        sets.append(["campaign_key", "adset_key"])
        if has_creative:
            sets.append(["campaign_key", "adset_key", "creative_key"])
    g = fine.groupingSets(sets, *KEYS).agg(
        F.sum("spend").alias("spend_sum"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum("reach").alias("reach"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        _first("c_name").alias("_c_first"),
        _first("a_name").alias("_a_first"),
        _first("r_name").alias("_r_first"),
        F.grouping_id().alias("_gid"),
    )
    level = F.when(F.col("_gid") == 3, "campaign").when(F.col("_gid") == 1, "adset").otherwise("creative")
    name = (
        F.when(F.col("_gid") == 3, F.col("_c_first"))
        .when(F.col("_gid") == 1, F.col("_a_first"))
        .otherwise(F.col("_r_first"))
    )
    out = g.select(
        level.alias("level"),
        "campaign_key",
        F.when(F.col("_gid") <= 1, F.col("adset_key")).alias("adset_key"),
        F.when(F.col("_gid") == 0, F.col("creative_key")).alias("creative_key"),
        name.alias("name"),
        "spend_sum",
        "impressions",
        "clicks",
        "reach",
        "first_date",
        "last_date",
        "_gid",
    )
    own_key_present = (
        F.col("campaign_key").isNotNull()
        & ((F.col("_gid") == 3) | F.col("adset_key").isNotNull())
        & ((F.col("_gid") != 0) | F.col("creative_key").isNotNull())
    )
    return out.where(own_key_present).drop("_gid")


TOTALS_LEVEL = "__totals__"


def lead_level_emails(leads_f: DataFrame) -> DataFrame:
    """A9 input: distinct (level, keys, e-mail); a level needs all its keys
    non-blank.  One extra level (TOTALS_LEVEL, no keys) lists every lead
    e-mail once, so the run's distinct lead count comes out of the same
    aggregate instead of a second pass over the leads.

    A lead is shuffled as one row, not as one per level: distinct (keys,
    e-mail) first, dealt by e-mail next, and only then repeated per level.
    The rows of an e-mail are together then, so neither their distinct nor the
    join with the e-mail's outcome shuffles them again.  A shared e-mail has
    at most a row per creative there."""
    return _level_rows(_lead_keys(leads_f).distinct().repartition("email")).distinct()


def lead_level_rows(leads_f: DataFrame) -> DataFrame:
    """The rows of ``lead_level_emails``, each as often as it comes."""
    return _level_rows(_lead_keys(leads_f))


def _lead_keys(leads_f: DataFrame) -> DataFrame:
    """Keys and e-mail of the leads that have an e-mail."""
    keys = [norm_key(c).alias(k) for c, k in zip(LEVELS, KEYS, strict=True)]
    return leads_f.select(norm_key("email").alias("email"), *keys).where(F.col("email").isNotNull())


def _level_rows(leads: DataFrame) -> DataFrame:
    """Each lead once per level whose keys it has."""
    c, a, r = (F.col(k) for k in KEYS)
    none = _null_str()
    levels = F.array(
        F.struct(F.lit("campaign").alias("level"), c.alias("campaign_key"), none.alias("adset_key"), none.alias("creative_key")),
        F.struct(F.lit("adset").alias("level"), c.alias("campaign_key"), a.alias("adset_key"), none.alias("creative_key")),
        F.struct(F.lit("creative").alias("level"), c.alias("campaign_key"), a.alias("adset_key"), r.alias("creative_key")),
        F.struct(F.lit(TOTALS_LEVEL).alias("level"), none.alias("campaign_key"), none.alias("adset_key"), none.alias("creative_key")),
    )
    rows = leads.select("email", F.explode(levels).alias("k")).select("email", "k.*")
    nonblank = lambda col: F.coalesce(F.col(col) != "", F.lit(False))
    level = F.col("level")
    keep = (level == TOTALS_LEVEL) | (
        nonblank("campaign_key")
        & ((level == "campaign") | nonblank("adset_key"))
        & ((level != "creative") | nonblank("creative_key"))
    )
    return rows.where(keep)


def appt_pairs(appts_f: DataFrame, has_campaign: bool = True) -> DataFrame:
    """Distinct (campaign_key, e-mail) of the filtered appointments.

    Null e-mails are dropped here, once, so that every consumer sees the same
    plan and Spark can reuse this shuffle instead of repeating it.
    """
    c = norm_key("campaign") if has_campaign else _null_str()
    return (
        appts_f.select(c.alias("campaign_key"), norm_key("email").alias("email"))
        .where(F.col("email").isNotNull())
        .distinct()
    )


def sale_pairs(sales_f: DataFrame, has_campaign: bool = True, has_revenue: bool = True) -> DataFrame:
    """(campaign_key, e-mail) of the filtered sales with their summed revenue."""
    c = norm_key("campaign") if has_campaign else _null_str()
    rev = F.col("revenue").cast(MONEY) if has_revenue else F.lit(0).cast(MONEY)
    return (
        sales_f.select(c.alias("campaign_key"), norm_key("email").alias("email"), rev.alias("revenue"))
        .groupBy("campaign_key", "email")
        .agg(F.sum("revenue").alias("revenue"))
    )


def email_summary(appts: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per e-mail: booked?, bought?, total revenue over all its sales
    (A8).  One shuffle on e-mail serves the attribution join and the run
    totals.  Sales without an e-mail keep one null group so their revenue
    still counts in the total (the join never matches it)."""
    zero = F.lit(0).cast(MONEY)
    booked = appts.select("email", F.lit(1).alias("has_appt"), F.lit(0).alias("has_sale"), zero.alias("revenue"))
    bought = sales.select("email", F.lit(0).alias("has_appt"), F.lit(1).alias("has_sale"), "revenue")
    return (
        booked.unionByName(bought)
        .groupBy("email")
        .agg(
            F.max("has_appt").alias("has_appt"),
            F.max("has_sale").alias("has_sale"),
            F.sum("revenue").alias("revenue"),
        )
    )


def lead_facts(level_emails: DataFrame, emails: DataFrame) -> DataFrame:
    """A9 + J4-J6: per (level, keys): distinct leads, how many of them booked,
    bought, and the total revenue of the buyers (each e-mail counted once)."""
    outcomes = emails.select("email", "has_appt", "has_sale", "revenue")
    j = level_emails.join(outcomes, "email", "left")
    return j.groupBy("level", *KEYS).agg(
        F.count(F.lit(1)).alias("leads"),
        F.sum(F.coalesce(F.col("has_appt"), F.lit(0))).alias("appointments"),
        F.sum(F.coalesce(F.col("has_sale"), F.lit(0))).alias("sales"),
        F.coalesce(F.sum(F.when(F.col("has_sale") == 1, F.col("revenue"))), F.lit(0).cast(MONEY)).alias("revenue"),
    )


def appts_by_campaign(pairs: DataFrame) -> DataFrame:
    """A10: distinct appointment e-mails by the appointment's own campaign
    (blank campaigns were already removed by F5)."""
    return pairs.groupBy("campaign_key").agg(F.count("email").alias("appointments"))


def sales_by_campaign(pairs: DataFrame, skip_blank: bool = True) -> DataFrame:
    """Distinct buyers and summed revenue by the sale's own campaign.

    Blank campaigns are skipped in the output; inside the tree the blank
    group is harmless (no ads campaign is blank: F1 needs the keyword) and
    keeping it lets the pair shuffle be shared.
    """
    out = pairs.groupBy("campaign_key").agg(F.count("email").alias("sales"), F.sum("revenue").alias("revenue"))
    if skip_blank:
        out = out.where(F.coalesce(F.col("campaign_key") != "", F.lit(False)))
    return out


def own_facts(appts_c: DataFrame | None, sales_c: DataFrame | None, emails: DataFrame) -> DataFrame:
    """Facts counted on the records' own campaign (A10, A11), plus the run
    totals (A6, A7) as the TOTALS_LEVEL row: appointments, sales, revenue."""
    zero_m = F.lit(0).cast(MONEY)
    zero = F.lit(0).cast("long")
    known = F.col("email").isNotNull()
    parts = [
        emails.agg(
            F.count(F.when(known & (F.col("has_appt") == 1), F.lit(1))).alias("appointments"),
            F.count(F.when(known & (F.col("has_sale") == 1), F.lit(1))).alias("sales"),
            F.coalesce(F.sum("revenue"), zero_m).alias("revenue"),
        ).select(F.lit(TOTALS_LEVEL).alias("level"), _null_str().alias("campaign_key"), "appointments", "sales", "revenue")
    ]
    if appts_c is not None:
        parts.append(appts_c.select(F.lit("campaign").alias("level"), "campaign_key", "appointments", zero.alias("sales"), zero_m.alias("revenue")))
    if sales_c is not None:
        parts.append(sales_c.select(F.lit("campaign").alias("level"), "campaign_key", zero.alias("appointments"), "sales", "revenue"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("level", "campaign_key").agg(
        F.sum("appointments").alias("appointments"), F.sum("sales").alias("sales"), F.sum("revenue").alias("revenue")
    )


def level_facts(lead_facts_all: DataFrame, own: DataFrame) -> DataFrame:
    """Facts for every tree level plus the run-totals row.

    Campaign rows take leads from the lead attribution but appointments /
    sales / revenue from the records' own campaign (the two attribution
    models of the dashboard); ad set and creative rows take everything from
    the lead attribution.  The two sources are stacked, each with the other's
    measures null, and merged by one aggregate on all four keys: the rows of a
    large campaign are dealt by ad set and creative as well, where a join
    could only be dealt by campaign (the own-campaign side has no other key).
    """
    by_lead = ~F.col("level").isin("campaign", TOTALS_LEVEL)
    measures = ("appointments", "sales", "revenue")
    leads = lead_facts_all.select("level", *KEYS, "leads", *[F.when(by_lead, F.col(m)).alias(m) for m in measures])
    owned = own.select(
        "level", "campaign_key", _null_str().alias("adset_key"), _null_str().alias("creative_key"),
        F.lit(None).cast("long").alias("leads"), *measures,
    )
    zero = F.lit(0).cast("long")
    return leads.unionByName(owned).groupBy("level", *KEYS).agg(
        F.coalesce(F.max("leads"), zero).alias("leads"),
        F.coalesce(F.max("appointments"), zero).alias("appointments"),
        F.coalesce(F.max("sales"), zero).alias("sales"),
        F.coalesce(F.max("revenue"), F.lit(0).cast(MONEY)).alias("revenue"),
    )


def with_ratios(df: DataFrame) -> DataFrame:
    """M1 on unrounded inputs: spend / revenue DOUBLE, counts integral."""
    return df.select(
        "*",
        (safe_div("clicks", "impressions") * 100).alias("_ctr"),
        safe_div("spend_d", "leads").alias("_cpl"),
        safe_div("spend_d", "sales").alias("_cac"),
        safe_div("revenue_d", "spend_d").alias("_roas"),
        (safe_div("leads", "clicks") * 100).alias("_cvr"),
        (safe_div("appointments", "leads") * 100).alias("_appt"),
        (safe_div("sales", "appointments") * 100).alias("_close"),
    )


ROW_METRICS = [
    "spend", "impressions", "clicks", "leads", "appointments", "sales", "revenue",
    "ctr", "cpl", "cac", "roas", "conversion_rate", "appointment_rate", "close_rate",
]


def rounded_metrics() -> list[Column]:
    """Row metrics as the dashboard shows them (money and ratios to 2 dp)."""
    return [
        round2("spend_d").alias("spend"),
        F.col("impressions").cast("long").alias("impressions"),
        F.col("clicks").cast("long").alias("clicks"),
        F.col("leads").cast("long").alias("leads"),
        F.col("appointments").cast("long").alias("appointments"),
        F.col("sales").cast("long").alias("sales"),
        round2("revenue_d").alias("revenue"),
        round2("_ctr").alias("ctr"),
        round2("_cpl").alias("cpl"),
        round2("_cac").alias("cac"),
        round2("_roas").alias("roas"),
        round2("_cvr").alias("conversion_rate"),
        round2("_appt").alias("appointment_rate"),
        round2("_close").alias("close_rate"),
    ]


def tree_rows(rollup: DataFrame, facts_all: DataFrame) -> DataFrame:
    """J1-J3 + J7 + M1: the unscored tree (one row per level group)."""
    f = facts_all.select(
        F.col("level").alias("_fl"), F.col("campaign_key").alias("_fc"), F.col("adset_key").alias("_fa"),
        F.col("creative_key").alias("_fr"), "leads", "appointments", "sales", F.col("revenue").alias("_rev"),
    )
    on = [
        rollup["level"] == f["_fl"],
        rollup["campaign_key"] == f["_fc"],
        rollup["adset_key"].eqNullSafe(f["_fa"]),
        rollup["creative_key"].eqNullSafe(f["_fr"]),
    ]
    j = rollup.join(f, on, "left").select(
        "level", *KEYS, "name",
        F.col("spend_sum").cast("double").alias("spend_d"),
        "impressions", "clicks",
        F.coalesce("leads", F.lit(0)).alias("leads"),
        F.coalesce("appointments", F.lit(0)).alias("appointments"),
        F.coalesce("sales", F.lit(0)).alias("sales"),
        F.coalesce(F.col("_rev"), F.lit(0).cast(MONEY)).cast("double").alias("revenue_d"),
    )
    # Parent display names.
    camp_names = rollup.where(F.col("level") == "campaign").select(
        F.col("campaign_key").alias("_pc"), F.col("name").alias("campaign_name")
    )
    adset_names = rollup.where(F.col("level") == "adset").select(
        F.col("campaign_key").alias("_qc"), F.col("adset_key").alias("_qa"), F.col("name").alias("adset_name")
    )
    j = (
        j.join(camp_names, (j["campaign_key"] == camp_names["_pc"]) & (j["level"] != "campaign"), "left")
        .join(adset_names, (j["campaign_key"] == adset_names["_qc"]) & (j["adset_key"] == adset_names["_qa"]) & (j["level"] == "creative"), "left")
        .drop("_pc", "_qc", "_qa")
    )
    r = with_ratios(j)
    ident = F.concat_ws("|", *KEYS)
    return r.select("level", ident.alias("id"), *KEYS, "name", "campaign_name", "adset_name", *rounded_metrics())
