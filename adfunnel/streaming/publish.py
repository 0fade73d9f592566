"""One publisher for all four tables.

It runs on a timer of its own, with or without new data, so an open date window
moves on with the day.  Each run takes the vector of complete ingest batches
(one number per table) as it finds it, merges the rows that came or entered the
window since the last commit into the state, writes the payload as a snapshot,
and last a manifest row: the commit, the batches it covers, its window and its
snapshot.  What no manifest names doesn't count, so a snapshot never mixes
batches, and a run that fails is simply done again at the next tick.
"""

from __future__ import annotations

import json
import logging
import threading
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DATA_REFRESH_SECONDS, FunnelConfig
from ..operators import filters as FL
from ..plans.funnel import Funnel
from ..session import path_exists
from ..sources.fixtures import FunnelTables
from . import log as L
from .state import State, StateFunnel, compact, merge

log = logging.getLogger(__name__)

TABLES = ("ads", "leads", "appointments", "sales")
COMPACT_AFTER = 32
_MANIFEST = "commit long, live array<long>, batches map<string,long>, date_start string, date_end string, rules string, snapshot string"


def rules_of(cfg: FunnelConfig) -> str:
    """The parts of the configuration that the state depends on, besides the window."""
    return json.dumps({k: v for k, v in asdict(cfg).items() if k not in ("date_start", "date_end", "campaign_filter", "weights")}, sort_keys=True, default=str)


def _rows(spark: SparkSession, work_dir: str, name: str, schema, after: int, upto: int) -> DataFrame:
    """Stored rows of the ingest batches in (after, upto], with their month; other batches' files are not opened."""
    root = f"{work_dir}/stored/{name}"
    cols = [f.name for f in schema]
    if upto <= after or not path_exists(spark, root):
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("month", F.lit(None).cast("string"))
    parts = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in schema)
    df = spark.read.schema(f"{parts[2:]}, batch_id long, month string").parquet(root)
    return df.where((F.col("batch_id") > after) & (F.col("batch_id") <= upto)).select(*cols, "month")


def _inside(name: str, cfg: FunnelConfig):
    return FL.ads_in_range(cfg) if name == "ads" else FL.day_in_range(cfg)


class Publisher:
    """Publishes snapshots of a work folder; one per work folder at a time."""

    def __init__(self, spark: SparkSession, work_dir: str, schemas: dict, config: FunnelConfig | None = None, buckets: int = 64, compact_after: int = COMPACT_AFTER):
        self.spark, self.work_dir, self.schemas = spark, work_dir, schemas
        self.config = config or FunnelConfig()
        self.buckets, self.compact_after = buckets, compact_after
        self._lock = threading.Lock()

    # ---- manifest ---------------------------------------------------------------
    def manifest(self):
        """The last commit, or None."""
        return L.last(self.spark, f"{self.work_dir}/commits", _MANIFEST, "commit")

    def _commit(self, **row) -> None:
        live = "array(" + ",".join(f"{c}L" for c in row.pop("live")) + ")"
        pairs = [x for k, v in row.pop("batches").items() for x in (F.lit(k), F.lit(v).cast("long"))]
        cols = [F.lit(v).alias(k) for k, v in row.items()]
        out = self.spark.range(1).select(*cols, F.expr(live).alias("live"), F.create_map(*pairs).alias("batches"))
        L.write(out, f"{self.work_dir}/commits/{row['commit']:012d}")

    def complete_batches(self, seen: dict[str, int]) -> dict[str, int]:
        """Per table the last complete ingest batch (a stream begins none before the one before is marked), -1 before the first."""
        return {n: L.last_number(self.spark, f"{self.work_dir}/ingested/{n}", seen.get(n, -1)) for n in TABLES}

    # ---- runs -----------------------------------------------------------------
    def run(self, source: str = "timer", force: bool = False) -> str | None:
        """Publish what is due; a failure keeps the last good snapshot and marks it stale, and the next run tries again."""
        with self._lock:
            try:
                return self._publish(source, force)
            except Exception as exc:
                log.error("refresh (%s) failed: %s", source, exc)
                try:
                    last = self.manifest()
                except Exception:
                    last = None
                L.refreshed(self.spark, self.work_dir, last.snapshot if last else None, source, stale=True)
                return None

    def _publish(self, source: str, force: bool) -> str:
        cfg = self.config.resolved()
        last, rules = self.manifest(), rules_of(cfg)
        batches = self.complete_batches(dict(last.batches) if last else {})
        grown = last is not None and last.rules == rules and last.date_start == cfg.date_start and last.date_end <= cfg.date_end
        same = grown and last.date_end == cfg.date_end and dict(last.batches) == batches
        if same and not force:  # nothing to add: the data is as fresh as now
            L.refreshed(self.spark, self.work_dir, last.snapshot, source, stale=False)
            return last.snapshot
        commit = last.commit + 1 if last else 0
        state = State(self.spark, f"{self.work_dir}/state", tuple(last.live) if grown else (), self.buckets)
        state = merge(state, commit, Funnel(self._delta(cfg, last if grown else None, batches), cfg))
        if len(state.commits) >= self.compact_after:
            commit += 1
            state = compact(state, commit)
        everything = FunnelTables(*(self._stored(n, -1, batches[n]).drop("month") for n in TABLES))
        snapshot = f"{self.work_dir}/snapshots/{L.new_id()}"
        funnel = StateFunnel(state, everything, cfg)
        funnel.write_outputs(snapshot, skip=("rule_alerts", "recommendations", "digest"))
        self._commit(commit=commit, live=state.commits, batches=batches, date_start=cfg.date_start, date_end=cfg.date_end, rules=rules, snapshot=snapshot)
        L.refreshed(self.spark, self.work_dir, snapshot, source, stale=False)
        return snapshot

    def _stored(self, name: str, after: int, upto: int) -> DataFrame:
        return _rows(self.spark, self.work_dir, name, self.schemas[name], after, upto)

    def _delta(self, cfg: FunnelConfig, last, batches: dict[str, int]) -> FunnelTables:
        """New batches' rows in the window, and earlier rows that the window has come to hold."""
        out = []
        for name in TABLES:
            seen = last.batches[name] if last else -1
            if "date" not in self.schemas[name].names:  # no window without a date
                out.append(self._stored(name, seen, batches[name]).drop("month"))
                continue
            months = F.col("month").between(cfg.date_start[:7], cfg.date_end[:7])
            rows = self._stored(name, seen, batches[name]).where(months & _inside(name, cfg))
            if last and last.date_end < cfg.date_end:
                was = replace(cfg, date_end=last.date_end)
                # an ads row of the last day itself may have been too late
                later = (F.col("month") >= last.date_end[:7]) & (F.col("date") >= FL.ts_lit(last.date_end))
                rows = rows.unionByName(self._stored(name, -1, seen).where(months & later & _inside(name, cfg) & ~_inside(name, was)))
            out.append(rows.drop("month"))
        return FunnelTables(*out)

    def start(self, interval_seconds: int = DATA_REFRESH_SECONDS) -> StreamingQuery:
        """Run at every tick, from a stream of seconds as the timer, so that ticks come without new data too."""
        seconds = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def tick(batch: DataFrame, batch_id: int) -> None:
            self.run(f"timer:{batch_id}")

        w = seconds.writeStream.foreachBatch(tick).trigger(processingTime=f"{interval_seconds} seconds")
        return w.queryName(f"adfunnel_publish_{L.new_id()}").start()
