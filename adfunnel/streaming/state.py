"""Mergeable funnel state: new rows are merged in, history is not recomputed.

What the tree needs of the raw rows is kept as tables that only grow, one
folder per commit; a table's content is the union, or the sum, of its live
commits:

* ``ads``: phase 1 of the roll-up (sums and least row order per spelling),
  a row per ad group, summed over commits;
* ``leads``: distinct (level, keys, e-mail);
* ``appointments``: distinct (campaign, e-mail);
* ``sales``: (campaign, e-mail, revenue); a pair may stand in several commits,
  ``first`` marks the one that brought it;
* ``outcomes``: per e-mail what was added to booked?, bought? and revenue;
* ``facts``: per (level, keys) what was added to leads, appointments, sales
  and revenue.

The tables of pairs are partitioned by a hash bucket of the e-mail.  A merge
reads only the buckets that new rows touch, keeps the pairs that are really
new, and adds to ``facts`` what they and the changed outcomes are worth.  A
pair is written once and a fact is a sum, so the order of the rows doesn't
matter.  A commit's folders count only once a manifest names the commit, and a
repeated attempt writes over the folders of the failed one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FunnelConfig
from ..functions.clean import MONEY, norm_key
from ..operators import rollup as RU
from ..plans.funnel import Funnel
from ..sources.fixtures import FunnelTables

_KEYS = "campaign_key string, adset_key string, creative_key string"
SCHEMAS = {
    "ads": f"{_KEYS}, c_name string, a_name string, r_name string, spend decimal(38,6), impressions double, clicks double, reach double, _ord long, first_date timestamp_ntz, last_date timestamp_ntz",
    "leads": f"level string, {_KEYS}, email string, bucket int",
    "appointments": "campaign_key string, email string, bucket int",
    "sales": "campaign_key string, email string, revenue decimal(38,6), first boolean, bucket int",
    "outcomes": "email string, has_appt long, has_sale long, revenue decimal(38,6), bucket int",
    "facts": f"level string, {_KEYS}, leads long, appointments long, sales long, revenue decimal(38,6)",
}
MEASURES = ("leads", "appointments", "sales", "revenue")


def _money0():
    return F.lit(0).cast(MONEY)


def _long(value: int):
    return F.lit(value).cast("long")


def _null():
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class State:
    """The live commits under a folder."""

    spark: SparkSession
    root: str
    commits: tuple[int, ...] = ()
    buckets: int = 64

    def with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("email"), F.lit(self.buckets)).cast("int"))

    def table(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """The rows of all live commits; of the buckets ``touched`` only, if given (other files are not opened)."""
        schema = T.StructType.fromDDL(SCHEMAS[name])
        paths = [f"{self.root}/{name}/commit={c}" for c in self.commits]
        if not paths or touched == []:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.option("basePath", f"{self.root}/{name}").schema(T.StructType.fromDDL(SCHEMAS[name] + ", commit long")).parquet(*paths)
        if touched is not None and len(touched) < self.buckets:
            df = df.where(F.col("bucket").isin(touched))
        return df.select(*schema.names)

    def write(self, name: str, df: DataFrame, commit: int) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[name])
        df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        path = f"{self.root}/{name}/commit={commit}"
        if "bucket" in schema.names:
            # a file per bucket, so that a merge opens no more files than it touches buckets
            df.repartition("bucket").sortWithinPartitions("bucket", "email").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        return replace(self, commits=(commit,)).table(name)

    @cached_property
    def fine(self) -> DataFrame:
        return RU.merge_fine(self.table("ads"))

    @cached_property
    def facts(self) -> DataFrame:
        """What ``rollup.level_facts`` computes from all rows."""
        return self.table("facts").groupBy("level", *RU.KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))


def _touched(frames: list[DataFrame]) -> list[int]:
    """The buckets of some rows: at most as many numbers as there are buckets."""
    some = reduce(DataFrame.unionByName, (f.select("bucket") for f in frames)).distinct()
    return sorted(r.bucket for r in some.collect())


def _unseen(rows: DataFrame, old: DataFrame) -> DataFrame:
    """The distinct ``rows`` that are not in ``old`` (same columns, nulls equal), by one aggregate: both sides are dealt once."""
    keys = old.columns
    both = rows.select(*keys, F.lit(False).alias("known")).unionByName(old.select(*keys, F.lit(True).alias("known")))
    return both.groupBy(*keys).agg(F.bool_or("known").alias("known")).where("not known").drop("known")


def merge(state: State, commit: int, new: Funnel) -> State:
    """The state with the rows of ``new`` (a funnel over new rows only), written as ``commit``."""
    ads = new.ads_f
    state.write("ads", RU.fine_ads(RU.keyed_ads(ads, new.res.has("ads", "adset"), new.res.has("ads", "creative"), new.has_order)), commit)

    pairs = state.with_bucket(RU.lead_level_rows(new.leads_f))
    booked = state.with_bucket(new.appt_pairs)
    bought = state.with_bucket(new.sale_pairs)
    # of the rows themselves, counted off in every map task: the pairs would be dealt out a second time for it
    emails = lambda df: state.with_bucket(df.select(norm_key("email").alias("email")))
    named_only = [emails(df).where("email is not null") for df in (new.leads_f, new.appts_f)]
    touched = _touched([*named_only, emails(new.sales_f)])
    old_leads = state.table("leads", touched)

    on = lambda a, b, keys: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))
    new_leads = state.write("leads", _unseen(pairs, old_leads), commit)
    old_appts = state.table("appointments", touched)
    new_appts = state.write("appointments", booked.join(old_appts, on(booked, old_appts, ["bucket", "campaign_key", "email"]), "left_anti"), commit)
    known = state.table("sales", touched).where("first").select("bucket", "campaign_key", "email")
    fresh = bought.join(known, on(bought, known, ["bucket", "campaign_key", "email"]), "left_anti").withColumn("first", F.lit(True))
    again = bought.join(known, on(bought, known, ["bucket", "campaign_key", "email"]), "left_semi").withColumn("first", F.lit(False))
    new_sales = state.write("sales", fresh.unionByName(again).withColumn("revenue", F.coalesce("revenue", _money0())), commit)

    # per e-mail: what it was, and what it becomes
    came = RU.email_summary(new_appts, new_sales)
    named = F.col("email").isNotNull()
    sums = [F.sum(c).alias(c) for c in ("has_appt", "has_sale", "revenue")]
    before = state.table("outcomes", touched).groupBy(F.col("email").alias("e")).agg(*(F.sum(c).alias("old_" + c) for c in ("has_appt", "has_sale", "revenue")))
    change = came.join(before, F.col("email") == F.col("e"), "left").select(
        "email",
        *(F.when(named, F.greatest(F.col(c).cast("long") - F.coalesce("old_" + c, _long(0)), _long(0))).otherwise(_long(0)).alias(c) for c in ("has_appt", "has_sale")),
        F.coalesce("revenue", _money0()).alias("revenue"),
    )
    change = change.where("has_appt <> 0 or has_sale <> 0 or revenue <> 0")
    changed = state.write("outcomes", state.with_bucket(change), commit)
    after = replace(state, commits=(*state.commits, commit))

    # pairs known before gain what their e-mail gains; new pairs come with all that it has
    zero = _long(0)
    gain = changed.where(named).select("email", "has_appt", "has_sale", "revenue")
    worth = after.table("outcomes", touched).where(named).groupBy("email").agg(*sums)
    grown = old_leads.join(gain, "email").select("level", *RU.KEYS, zero.alias("leads"), "has_appt", "has_sale", "revenue")
    added = new_leads.join(worth, "email", "left").select(
        "level", *RU.KEYS, _long(1).alias("leads"), F.coalesce("has_appt", zero).alias("has_appt"), F.coalesce("has_sale", zero).alias("has_sale"),
        F.when(F.col("has_sale") > 0, F.col("revenue")).otherwise(_money0()).alias("revenue"),
    )
    below = F.col("level").isin("adset", "creative")  # campaigns and totals count the records' own campaign
    by_lead = grown.unionByName(added).select(
        "level", *RU.KEYS, "leads", F.when(below, F.col("has_appt")).otherwise(zero).alias("appointments"), F.when(below, F.col("has_sale")).otherwise(zero).alias("sales"),
        F.when(below, F.col("revenue")).otherwise(_money0()).alias("revenue"),
    )
    campaign = lambda df, a, s, r: df.select(F.lit("campaign").alias("level"), "campaign_key", _null().alias("adset_key"), _null().alias("creative_key"), zero.alias("leads"), a.alias("appointments"), s.alias("sales"), r.alias("revenue"))
    own = campaign(new_appts.where(named), _long(1), zero, _money0())
    own = own.unionByName(campaign(new_sales, zero, F.when(F.col("first") & named, _long(1)).otherwise(zero), F.col("revenue")))
    total = changed.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("has_appt", "has_sale", "revenue"))).select(
        F.lit(RU.TOTALS_LEVEL).alias("level"), *(_null().alias(k) for k in RU.KEYS), zero.alias("leads"), F.col("has_appt").alias("appointments"), F.col("has_sale").alias("sales"), F.col("revenue").cast(MONEY).alias("revenue")
    )
    facts = by_lead.unionByName(own).unionByName(total).groupBy("level", *RU.KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
    state.write("facts", facts, commit)
    return after


def compact(state: State, commit: int) -> State:
    """The same content as one commit, so that the number of files stays bounded."""
    state.write("ads", state.fine, commit)
    state.write("facts", state.facts, commit)
    for name in ("leads", "appointments"):
        state.write(name, state.table(name), commit)
    pair = state.table("sales").groupBy("bucket", "campaign_key", "email").agg(F.sum("revenue").alias("revenue")).withColumn("first", F.lit(True))
    state.write("sales", pair, commit)
    state.write("outcomes", state.table("outcomes").groupBy("bucket", "email").agg(*(F.sum(c).alias(c) for c in ("has_appt", "has_sale", "revenue"))), commit)
    return replace(state, commits=(commit,))


class StateFunnel(Funnel):
    """The funnel's outputs over the state: small tables, a row per ad group."""

    def __init__(self, state: State, tables: FunnelTables, config: FunnelConfig | None = None):
        super().__init__(tables, config, materialize=True)
        self.state = state

    @cached_property
    def rollup(self) -> DataFrame:
        return self._pin(RU.expand_rollup(self.state.fine, self.res.has("ads", "adset"), self.res.has("ads", "creative")))

    @cached_property
    def level_facts(self) -> DataFrame:
        return self._pin(self.state.facts)

