"""Ingest, merged state, publisher, insights and health."""

import datetime as dt
import random
import uuid
from collections import Counter
from dataclasses import replace

from helpers import CFG, ad, appt, lead, sale, tables

from pyspark.sql import functions as F

from adfunnel import Funnel
from adfunnel.session import checkpoint_dir
from adfunnel.sources.fixtures import FIXTURE_CONFIG, silver_tables
from adfunnel.streaming import log as L
from adfunnel.streaming.publish import Publisher
from adfunnel.streaming.refresh import TABLES, freshness, latest_insights, latest_snapshot, start_ingest, start_insights, start_refresh

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2025, 12, 10)


def _counted(df, cols=None):
    return Counter(tuple(r) for r in df.select(*sorted(cols or df.columns)).collect())


def _same(spark, snapshot, tables_, cfg):
    """The published tree and KPIs are those of the batch."""
    batch = Funnel(tables_, cfg, materialize=True)
    for name, df in (("performance_tree", batch.tree), ("kpis", batch.kpis), ("date_span", batch.date_span)):
        assert _counted(spark.read.parquet(f"{snapshot}/{name}")) == _counted(df), name


def _messy(rng, n):
    """Rows with shared e-mails, blanks, spellings, nulls, repeats and days around the window's edges."""
    camps = ["LEADS PRO a", "leads pro A ", "LEADS PRO b", "other", None, ""]
    days = [None, *(DAY + dt.timedelta(days=k, hours=h) for k in (-20, 0, 5, 20, 21, 22) for h in (0, 7))]
    mail = lambda: rng.choice([None, "", *(f"p{k}@x" for k in range(12)), " P1@x"])
    pick = lambda: (rng.choice(camps), rng.choice(["s1", "S1", "s2", "", None]), rng.choice(["c1", "c2", None]))
    ads = [ad(i, *pick(), rng.randrange(900), imp=float(rng.randrange(99)), clicks=float(rng.randrange(9)), date=rng.choice(days)) for i in range(n)]
    leads = [lead(mail(), *pick(), date=rng.choice(days)) for _ in range(n)]
    appts = [appt(mail(), pick()[0], date=rng.choice(days)) for _ in range(n)]
    sales = [sale(mail(), rng.randrange(-9, 90), pick()[0], date=rng.choice(days)) for _ in range(n)]
    return ads, leads, appts, sales


class Refresh:
    """A work folder that takes pieces of four tables."""

    def __init__(self, spark, tmp_path, schemas, cfg, **params):
        self.spark, self.work, self.schemas = spark, f"file://{tmp_path}/work", schemas
        self.src = {n: f"file://{tmp_path}/source/{n}" for n in TABLES}
        self.publisher = Publisher(spark, self.work, schemas, cfg, buckets=4, **params)

    def land(self, **new):
        for n, df in new.items():
            df.coalesce(1).write.mode("append").parquet(self.src[n])
            start_ingest(self.spark, n, self.src[n], self.schemas[n], self.work, available_now=True).awaitTermination()


def _pieces(spark, t, k):
    return [{n: df.where(f"pmod(xxhash64({', '.join(df.columns)}), {k}) = {i}") for n, df in t.as_dict().items()} for i in range(k)]


def test_merged_state_equals_batch_in_any_order(spark, tmp_path):
    t = tables(spark, *_messy(random.Random(1), 60))
    schemas = {n: df.schema for n, df in t.as_dict().items()}
    r = Refresh(spark, tmp_path, schemas, CFG, compact_after=3)
    pieces = [(n, df) for p in _pieces(spark, t, 2) for n, df in p.items()]
    random.Random(2).shuffle(pieces)
    for k, (n, df) in enumerate(pieces):
        r.land(**{n: df})
        if k % 2:
            snapshot = r.publisher.run()
    _same(spark, snapshot, t, CFG)
    m = r.publisher.manifest()
    assert len(m.live) < 3 < m.commit + 1  # compacted on the way


def test_window_grows_with_the_day_without_new_data(spark, tmp_path):
    t = tables(spark, *_messy(random.Random(3), 80))
    schemas = {n: df.schema for n, df in t.as_dict().items()}
    cfg = replace(CFG, date_end="2025-12-15")
    r = Refresh(spark, tmp_path, schemas, cfg)
    r.land(**t.as_dict())
    _same(spark, r.publisher.run(), t, cfg)
    for day, live in (("2025-12-30", 2), ("2025-12-31", 3), ("2025-12-12", 1)):  # a window that shrinks starts anew
        r.publisher.config = replace(cfg, date_end=day)
        _same(spark, r.publisher.run(), t, r.publisher.config)
        assert len(r.publisher.manifest().live) == live
    before = r.publisher.manifest()
    assert r.publisher.run() == before.snapshot and r.publisher.manifest() == before  # nothing due


def test_a_merge_reads_only_touched_buckets(spark, tmp_path):
    leads = [lead(f"p{k}@x", "LEADS PRO a", "s", "c") for k in range(4000)]
    t = tables(spark, [ad(1, "LEADS PRO a", "s", "c", 10)], leads, [appt("p1@x", "LEADS PRO a")], [sale("p2@x", 5, "LEADS PRO a")])
    schemas = {n: df.schema for n, df in t.as_dict().items()}
    r = Refresh(spark, tmp_path, schemas, CFG)
    r.publisher.buckets = 64
    r.land(**t.as_dict())
    r.publisher.run()
    more = tables(spark, [], [lead("p7@x", "LEADS PRO a", "s2", "c")], [appt("p7@x", "LEADS PRO a")], []).as_dict()
    r.land(leads=more["leads"], appointments=more["appointments"])
    from adfunnel.streaming import state as S

    read = []
    table = S.State.table
    S.State.table = lambda self, name, touched=None: read.append((name, touched, (df := table(self, name, touched)).count())) or df
    try:
        snapshot = r.publisher.run()
    finally:
        S.State.table = table
    pairs = [x for x in read if x[0] in ("leads", "appointments", "sales", "outcomes") and x[1] is not None]
    assert pairs and all(len(x[1]) == 1 for x in pairs) and max(x[2] for x in pairs) < 4 * 4000 / 64 * 2
    facts = spark.read.parquet(f"{snapshot}/performance_tree").where("level = 'adset'").select("adset_key", "leads", "appointments", "sales").collect()
    assert sorted(map(tuple, facts)) == [("s", 4000, 2, 1)]


def test_failing_refresh_is_stale_keeps_the_snapshot_and_heals(spark, tmp_path, monkeypatch):
    t = tables(spark, *_messy(random.Random(4), 20))
    schemas = {n: df.schema for n, df in t.as_dict().items()}
    r = Refresh(spark, tmp_path, schemas, CFG)
    first = freshness(spark, r.work).first()
    assert not first.connected and first.stale and not first.insights_ready and latest_snapshot(spark, r.work) is None
    one, two = _pieces(spark, t, 2)
    r.land(**one)
    good = r.publisher.run()
    r.land(**two)
    from adfunnel.streaming import publish as P

    with monkeypatch.context() as m:
        m.setattr(P.StateFunnel, "write_outputs", lambda *a, **k: 1 / 0)
        assert r.publisher.run() is None
    now = freshness(spark, r.work).first()
    assert now.connected and now.stale and now.refreshes == 1 and latest_snapshot(spark, r.work) == good
    _same(spark, r.publisher.run(), t, CFG)  # the half-written commit is written over
    now = freshness(spark, r.work).first()
    assert not now.stale and now.refreshes == 2 and latest_snapshot(spark, r.work) != good


def test_a_snapshot_never_mixes_batches(spark, tmp_path):
    """A batch that isn't marked complete is not read, whatever stands in its folder."""
    t = tables(spark, *_messy(random.Random(5), 20))
    schemas = {n: df.schema for n, df in t.as_dict().items()}
    r = Refresh(spark, tmp_path, schemas, CFG)
    r.land(**t.as_dict())
    half = t.sales.withColumn("month", F.date_format("date", "yyyy-MM"))
    half.write.partitionBy("month").parquet(f"{r.work}/stored/sales/batch_id=1")
    _same(spark, r.publisher.run(), t, CFG)
    assert dict(r.publisher.manifest().batches) == dict.fromkeys(TABLES, 0)


def test_insights_follow_their_own_cadence(spark, tmp_path):
    t = tables(spark, [ad(1, "LEADS PRO a", "s", "c", 100)], [lead("p@x", "LEADS PRO a", "s", "c")], [appt("p@x", "LEADS PRO a")], [sale("p@x", 5, "LEADS PRO a")])
    schemas = {n: df.schema for n, df in t.as_dict().items()}
    r = Refresh(spark, tmp_path, schemas, CFG)
    r.land(**t.as_dict())
    r.publisher.run()
    assert not freshness(spark, r.work).first().insights_ready
    start_insights(spark, r.work, available_now=True).awaitTermination()
    first = latest_insights(spark, r.work)
    assert freshness(spark, r.work).first().insights_ready and first.snapshot == latest_snapshot(spark, r.work)
    alerts = spark.read.parquet(f"{first.insights}/rule_alerts")
    assert _counted(alerts) == _counted(Funnel(t, CFG).alerts) and alerts.count()
    more = tables(spark, [ad(2, "LEADS PRO b", "s", "c", 50)]).as_dict()["ads"]
    r.land(ads=more)
    r.publisher.run()
    assert latest_insights(spark, r.work) == first  # until their own trigger
    start_insights(spark, r.work, available_now=True).awaitTermination()
    assert latest_insights(spark, r.work).snapshot == latest_snapshot(spark, r.work) != first.snapshot


def test_publisher_ticks_without_new_data(spark, tmp_path):
    import time

    t = tables(spark, [ad(1, "LEADS PRO a", "s", "c", 100)])
    schemas = {n: df.schema for n, df in t.as_dict().items()}
    r = Refresh(spark, tmp_path, schemas, CFG)
    r.land(**t.as_dict())
    q = r.publisher.start(interval_seconds=2)
    try:
        for _ in range(60):
            if q.exception() or L.refreshes(spark, r.work).count() >= 3:
                break
            time.sleep(1)
    finally:
        q.stop()
    rows = L.refreshes(spark, r.work).collect()
    assert len(rows) >= 3 and not any(x.stale for x in rows) and len({x.snapshot for x in rows}) == 1


def test_stream_equals_batch(spark):
    t = silver_tables(spark, SF)
    work = f"{checkpoint_dir(spark)}/test-refresh-{uuid.uuid4().hex[:8]}"
    src = {n: f"{work}/source/{n}" for n in TABLES}
    schemas = {}
    for n, df in t.as_dict().items():
        df.repartition(2).write.parquet(src[n])
        schemas[n] = df.schema
    start_refresh(spark, src, schemas, work, FIXTURE_CONFIG, available_now=True, files_per_batch=1, buckets=4)
    _same(spark, latest_snapshot(spark, work), t, FIXTURE_CONFIG)
    fr = freshness(spark, work).first()
    assert fr.connected and fr.refreshes >= 1 and not fr.stale and fr.insights_ready
