"""Plan shape: what the physical plans must (not) contain at scale."""

from adfunnel import Funnel
from adfunnel.plans import registry
from adfunnel.sources.fixtures import FIXTURE_CONFIG, silver_tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_hash_aggregates_raw_rows(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG)
    p = plan(f.rollup).splitlines()
    expand = next(i for i, line in enumerate(p) if "Expand" in line)
    below = "\n".join(p[expand:])
    # the grouping-set expansion runs over the output of a hash aggregate, not raw rows
    assert "HashAggregate" in below
    assert "SortAggregate" not in below


def test_no_python_udfs_and_no_cartesian(spark):
    for name in ["performance_tree", "campaigns_flat", "rule_alerts", "digest_lines", "kpis", "recommendations"]:
        p = plan(registry.queries()[name](spark, SF))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct"):
            assert bad not in p, (name, bad)


def test_level_facts_are_dealt_by_all_keys(spark):
    """No join that could only be dealt by campaign: a hot campaign's rows spread over its ad sets and creatives."""
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG)
    p = plan(f.level_facts)
    assert "FullOuter" not in p
    top = next(line for line in p.splitlines() if "Exchange hashpartitioning" in line)
    for key in ("level", "campaign_key", "adset_key", "creative_key"):
        assert f"{key}#" in top, top


def test_date_filter_reaches_the_scan(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG)
    p = plan(f.ads_f)
    assert "PushedFilters" in p and "GreaterThanOrEqual(date" in p and "LessThanOrEqual(date" in p


def test_projection_is_pruned(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG)
    p = plan(f.ads_f.select("spend"))
    read = [line for line in p.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert read and all("creative" not in line for line in read)


def test_payload_export_is_the_whole_payload(spark):
    """Each section holds the records of its query, null fields included."""
    import json

    got = {}
    for r in registry.queries()["payload_export"](spark, SF).collect():
        got.setdefault(r.section, []).append(json.loads(r.payload))
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG, materialize=True)
    span = f.date_span.first()
    (meta,) = got.pop("meta")
    assert meta["date_range"] == {"start": span.date_start, "end": span.date_end} and meta["stale"] is False and meta["last_sync"].endswith("Z")
    want = {"kpis": f.kpis, "performance_table": f.tree, "campaigns_flat": f.campaigns_flat, "adsets_flat": f.adsets_flat, "creatives_flat": f.creatives_flat, "creative_rankings.top_5": f.top_creatives, "creative_rankings.bottom_5": f.bottom_creatives}
    assert got.keys() == want.keys()
    for name, df in want.items():
        rows = [json.loads(x) for x in df.toJSON().collect()]
        dropped = sorted(json.dumps({k: v for k, v in r.items() if v is not None}, sort_keys=True) for r in got[name])
        assert dropped == sorted(json.dumps(r, sort_keys=True) for r in rows), name
        assert all(list(r) == df.columns for r in got[name]), name


def test_window_opens_its_months_only(spark):
    """Stored tables are partitioned by month: a window's predicate is a partition filter, and fewer files are read."""
    from pyspark.sql import functions as F

    from adfunnel.config import FunnelConfig

    silver = silver_tables(spark, SF)
    cfg = FunnelConfig(date_start="1996-01-10", date_end="1996-06-02")
    f = Funnel(silver, cfg)
    for df, whole in ((f.ads_f, silver.ads), (f.leads_f, silver.leads), (f.appts_f, silver.appointments), (f.sales_f, silver.sales)):
        p = plan(df)
        assert "PartitionFilters: [isnotnull(date_month" in p and "PushedFilters: [IsNotNull(date)" in p, p
        read = {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
        stored = whole.inputFiles()
        assert 0 < len(read) < len(stored) / 5
        assert all(x.split("date_month=")[1][:7] in {f"1996-0{m}" for m in range(1, 7)} for x in read)
        assert "date_month" not in df.columns


def test_window_of_months_keeps_all_its_rows(spark):
    """The same rows with and without the partition column, also at the edges of months."""
    from adfunnel.config import FunnelConfig
    from adfunnel.sources.fixtures import FunnelTables

    silver = silver_tables(spark, SF)
    plain = FunnelTables(*(df.drop("date_month") for df in silver.as_dict().values()))
    for start, end in (("1996-02-01", "1996-02-29"), ("1995-12-31", "1996-01-01"), ("1996-2-1", "1996-3-1")):
        cfg = FunnelConfig(date_start=start, date_end=end)
        a, b = Funnel(silver, cfg), Funnel(plain, cfg)
        for name in ("ads_f", "leads_f", "appts_f", "sales_f"):
            assert getattr(a, name).count() == getattr(b, name).count(), (name, start)
        assert a.ads_f.count() > 0
