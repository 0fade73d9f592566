"""The whole funnel as one bundle of lazy DataFrames.

``Funnel(tables, config)`` declares every output; nothing runs until an
output is collected or written.  With ``materialize=True`` the per-group
intermediates (one row per ad group, not per ad row) are written once as
Parquet tables in the shared checkpoint folder and read back, so every
output plans over small stored tables; ``write_outputs()`` produces the
whole payload as a snapshot.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FunnelConfig
from ..operators import filters as FL
from ..operators import hierarchy as H
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import rank as R
from ..operators import rollup as RU
from ..operators import rules as RL
from ..sources.fixtures import FunnelTables
from ..session import checkpoint_dir, remove
from ..sources.ingest import Resolution


def _all_present(tables: FunnelTables) -> Resolution:
    res = Resolution()
    for name, df in tables.as_dict().items():
        res.mapping[name] = {c: c for c in df.columns}
    return res


class Funnel:
    def __init__(
        self,
        tables: FunnelTables,
        config: FunnelConfig | None = None,
        resolution: Resolution | None = None,
        materialize: bool = False,
    ):
        """``materialize=True`` checkpoints the per-group intermediates (roll-up,
        level facts, per-e-mail summary) into the cluster's checkpoint folder
        the first time they are needed: later outputs plan over those small
        tables instead of re-planning the scans and joins of the raw data."""
        self.cfg = (config or FunnelConfig()).resolved()
        self.materialize = materialize
        self._run_id = uuid.uuid4().hex[:12]
        # views read by several outputs are stored only when many outputs
        # are produced in one run (write_outputs)
        self._pin_shared = False
        self.tables = tables
        self.res = resolution or _all_present(tables)
        self.has_order = "row_order" in tables.ads.columns
        # The ads table without a campaign column yields the empty payload.
        self.ads_usable = self.res.has("ads", "campaign") and len(tables.ads.columns) > 0

    # ---- filtered inputs (F1-F6) ------------------------------------------
    @cached_property
    def ads_f(self) -> DataFrame:
        ads = self.tables.ads
        if not self.ads_usable:
            # empty payload: no rows, but the canonical columns exist
            for c, t in (("campaign", "string"), ("adset", "string"), ("creative", "string"), ("date", "timestamp_ntz")):
                if c not in ads.columns:
                    ads = ads.withColumn(c, F.lit(None).cast(t))
            return ads.where(F.lit(False))
        return FL.filter_ads(ads, self.cfg, has_campaign=True)

    @cached_property
    def leads_f(self) -> DataFrame:
        leads = self.tables.leads
        if not (self.res.has("leads", "email") and self.res.has("leads", "campaign")):
            return leads.where(F.lit(False))
        return FL.filter_leads(leads, self.cfg, has_date=self.res.has("leads", "date"))

    @cached_property
    def appts_f(self) -> DataFrame:
        appts = self.tables.appointments
        if not self.res.has("appointments", "email"):
            return appts.where(F.lit(False))
        return FL.filter_appointments(
            appts, self.cfg, has_campaign=self.res.has("appointments", "campaign"), has_date=self.res.has("appointments", "date")
        )

    @cached_property
    def sales_f(self) -> DataFrame:
        sales = self.tables.sales
        if not self.res.has("sales", "email"):
            return sales.where(F.lit(False))
        return FL.filter_sales(
            sales,
            self.cfg,
            has_product=self.res.has("sales", "product"),
            has_origin=self.res.has("sales", "origin"),
            has_date=self.res.has("sales", "date"),
        )

    @property
    def has_revenue(self) -> bool:
        return self.res.has("sales", "revenue")

    # ---- aggregation core -------------------------------------------------
    def _pin(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write ``df`` as a Parquet table in the shared checkpoint folder and
        read it back: one job, lineage cut, and the read-back carries file
        statistics the planner can use.  (An eager ``checkpoint()`` of an
        uncached plan runs it twice: once for the action, once to write.)"""
        if not self.materialize:
            return df
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark)}/funnel-{self._run_id}/{uuid.uuid4().hex[:8]}"
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the stored intermediates; outputs that read them are gone too, written ones stay."""
        spark = self.tables.ads.sparkSession
        if not self.materialize:
            return
        remove(spark, f"{checkpoint_dir(spark)}/funnel-{self._run_id}")

    @cached_property
    def rollup(self) -> DataFrame:
        has_adset = self.res.has("ads", "adset")
        has_creative = self.res.has("ads", "creative")
        k = RU.keyed_ads(self.ads_f, has_adset, has_creative, self.has_order)
        return self._pin(RU.ads_rollup(k, has_adset, has_creative))

    @cached_property
    def level_emails(self) -> DataFrame:
        return RU.lead_level_emails(self.leads_f)

    @cached_property
    def appt_pairs(self) -> DataFrame:
        return RU.appt_pairs(self.appts_f, self.res.has("appointments", "campaign"))

    @cached_property
    def sale_pairs(self) -> DataFrame:
        return RU.sale_pairs(self.sales_f, self.res.has("sales", "campaign"), self.has_revenue)

    @cached_property
    def emails(self) -> DataFrame:
        return RU.email_summary(self.appt_pairs, self.sale_pairs)

    @cached_property
    def lead_facts_all(self) -> DataFrame:
        """Lead attribution per level, plus the run's distinct-lead row."""
        return RU.lead_facts(self.level_emails, self.emails)

    @cached_property
    def lead_facts(self) -> DataFrame:
        return self.lead_facts_all.where(F.col("level") != RU.TOTALS_LEVEL)

    @cached_property
    def appts_by_campaign(self) -> DataFrame | None:
        return RU.appts_by_campaign(self.appt_pairs) if self.res.has("appointments", "campaign") else None

    @cached_property
    def sales_by_campaign(self) -> DataFrame | None:
        return RU.sales_by_campaign(self.sale_pairs) if self.res.has("sales", "campaign") else None

    @cached_property
    def level_facts(self) -> DataFrame:
        """Per-level facts plus the run-totals row; one job, one stored table."""
        sales_c = RU.sales_by_campaign(self.sale_pairs, skip_blank=False) if self.res.has("sales", "campaign") else None
        own = RU.own_facts(self.appts_by_campaign, sales_c, self.emails)
        return self._pin(RU.level_facts(self.lead_facts_all, own))

    def _prefetch(self, *names: str) -> None:
        """Materialise independent intermediates concurrently (two Spark jobs
        in flight share the cluster instead of running back to back)."""
        todo = [n for n in names if n not in self.__dict__]
        if not self.materialize or len(todo) < 2:
            return
        with ThreadPoolExecutor(max_workers=len(todo)) as pool:
            list(pool.map(lambda n: getattr(self, n), todo))

    @cached_property
    def unscored_tree(self) -> DataFrame:
        self._prefetch("rollup", "level_facts")
        return RU.tree_rows(self.rollup, self.level_facts)

    @cached_property
    def tree(self) -> DataFrame:
        """performance_tree: every level, scored (H1, M3, M4)."""
        return self._pin(H.performance_tree(self.unscored_tree, self.cfg.weights))

    def tree_filtered(self, campaign: str | None = None) -> DataFrame:
        """F8: tree restricted to campaigns whose name contains ``campaign``."""
        return FL.campaign_filter(self.tree, campaign if campaign is not None else self.cfg.campaign_filter)

    # ---- consolidated views (H3) -------------------------------------------
    @cached_property
    def consolidated(self) -> DataFrame:
        """The three consolidated views as one table, a partition per root."""
        return self._pin(H.consolidate(self.tree, H.LEVELS, self.cfg.weights, store=self._pin), by="root")

    def _flat(self, root: str) -> DataFrame:
        # views read by several outputs are made together when many outputs are produced in one run
        if self._pin_shared:
            return self.consolidated.where(F.col("root") == root).drop("root")
        return H.consolidate(self.tree, root, self.cfg.weights, store=self._pin)

    @cached_property
    def campaigns_flat(self) -> DataFrame:
        return self._flat("campaign")

    @cached_property
    def adsets_flat(self) -> DataFrame:
        return self._flat("adset")

    @cached_property
    def creatives_flat(self) -> DataFrame:
        return self._flat("creative")

    def level_view(self, level: str = "all") -> DataFrame:
        """the consolidated table of one level; the tree for 'all', for
        an unknown level and where that table is empty (a look at one row)."""
        if level not in H.LEVELS:
            return self.tree
        view = getattr(self, f"{level}s_flat")
        return self.tree if view.isEmpty() else view

    # ---- run-level figures --------------------------------------------------
    @cached_property
    def ads_present(self) -> DataFrame:
        if not self.ads_usable:
            return self.tables.ads.sparkSession.range(1).select(F.lit(False).alias("ads_present"))
        return M.ads_present(self.tables.ads)

    @cached_property
    def ads_totals(self) -> DataFrame:
        return M.ads_totals(self.rollup)

    @cached_property
    def funnel_totals(self) -> DataFrame:
        return M.funnel_totals(self.level_facts, RU.TOTALS_LEVEL)

    @cached_property
    def kpis(self) -> DataFrame:
        self._prefetch("rollup", "level_facts")
        return M.kpis(self.ads_totals, self.funnel_totals, self.ads_present)

    @cached_property
    def date_span(self) -> DataFrame:
        return M.date_span(self.rollup)

    # ---- rankings, insights ----------------------------------------------------
    @cached_property
    def top_creatives(self) -> DataFrame:
        return R.top_creatives(self.creatives_flat)

    @cached_property
    def bottom_creatives(self) -> DataFrame:
        return R.bottom_creatives(self.creatives_flat)

    @cached_property
    def alerts(self) -> DataFrame:
        return RL.rule_alerts(self.tree, self.kpis)

    @cached_property
    def recommendations(self) -> DataFrame:
        return RL.recommendations(self.tree)

    @cached_property
    def digest(self) -> DataFrame:
        # top and bottom both read the consolidated creatives: store it once
        if "creatives_flat" not in self.__dict__:
            self.creatives_flat = self._pin(self._flat("creative"))
        return RL.digest_lines(self.tree, self.kpis, self.top_creatives, self.bottom_creatives)

    @cached_property
    def metric_classes(self) -> DataFrame:
        return RL.metric_classes(self.tree, self.kpis)

    # ---- diagnostics ---------------------------------------------------------------
    def filter_audit(self) -> DataFrame:
        t = self.tables
        return Q.filter_audit(t.ads, t.leads, t.appointments, t.sales, self.cfg)

    def campaign_match(self) -> DataFrame:
        return Q.campaign_match(self.tree)

    def campaign_keys(self) -> DataFrame:
        """Keys of the roll-up, and of the distinct pairs that attribution uses."""
        return Q.campaign_keys(self.ads_keys, self.appt_keys, self.sale_keys)

    @property
    def ads_keys(self) -> DataFrame:
        """One row per campaign of the filtered ads, from the roll-up."""
        return self.rollup.where("level = 'campaign'").select("campaign_key")

    @property
    def appt_keys(self) -> DataFrame:
        appts = self.appts_f if self.res.has("appointments", "campaign") else self.appts_f.where(F.lit(False))
        return Q.distinct_keys(appts)

    @property
    def sale_keys(self) -> DataFrame:
        return Q.distinct_keys(self.sales_f)

    def key_overlap(self, table: str) -> DataFrame:
        """Campaign keys of ``appointments`` or ``sales`` that the ads have too."""
        return Q.key_overlap({"appointments": self.appt_keys, "sales": self.sale_keys}[table], self.ads_keys)

    def write_outputs(self, path: str, workers: int = 4, skip: tuple[str, ...] = ()) -> dict[str, str]:
        """Write the payload, but for the tables in ``skip``, as Parquet tables
        under ``path`` (a gold snapshot), running independent outputs as
        concurrent jobs that share the stored intermediates.  Nothing passes
        through the driver."""
        self._pin_shared = self.materialize
        _ = self.consolidated
        outs = {k: v for k, v in self.outputs().items() if k not in skip}

        def write(item):
            name, df = item
            target = f"{path}/{name}"
            df.write.mode("overwrite").parquet(target)
            return name, target

        with ThreadPoolExecutor(max_workers=workers) as pool:
            return dict(pool.map(write, outs.items()))

    def payload(self) -> DataFrame:
        """(section, payload): the dashboard's document, one JSON row per
        record, so that no row and no task holds a whole table (S5)."""
        self._pin_shared = self.materialize
        _ = self.consolidated
        synced = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        span = F.struct(F.col("date_start").alias("start"), F.col("date_end").alias("end"))
        sections = {
            "meta": self.date_span.select(synced.alias("last_sync"), F.lit(False).alias("stale"), span.alias("date_range")),
            "kpis": self.kpis,
            "performance_table": self.tree,
            "campaigns_flat": self.campaigns_flat,
            "adsets_flat": self.adsets_flat,
            "creatives_flat": self.creatives_flat,
            "creative_rankings.top_5": self.top_creatives,
            "creative_rankings.bottom_5": self.bottom_creatives,
        }
        rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload")) for name, df in sections.items()]
        return reduce(DataFrame.unionByName, rows)

    def outputs(self) -> dict[str, DataFrame]:
        """The payload as named tables."""
        return {
            "kpis": self.kpis,
            "date_span": self.date_span,
            "performance_tree": self.tree,
            "campaigns_flat": self.campaigns_flat,
            "adsets_flat": self.adsets_flat,
            "creatives_flat": self.creatives_flat,
            "top_creatives": self.top_creatives,
            "bottom_creatives": self.bottom_creatives,
            "rule_alerts": self.alerts,
            "recommendations": self.recommendations,
            "digest": self.digest,
        }


def build_funnel(tables: FunnelTables, config: FunnelConfig | None = None, resolution: Resolution | None = None) -> Funnel:
    return Funnel(tables, config, resolution)
