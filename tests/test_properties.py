"""Invariants of the funnel on the driver's small tables."""

from pyspark.sql import functions as F

from adfunnel import Funnel
from adfunnel.sources.fixtures import FIXTURE_CONFIG, silver_tables

SF = "/root/testdata/sf0.001"


def test_spend_adds_up(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG)
    total = f.rollup.where("level = 'campaign'").agg(F.sum("spend_sum")).collect()[0][0]
    k = f.kpis.collect()[0]
    assert round(float(total), 2) == k["total_spend"]
    raw = f.ads_f.agg(F.sum("spend")).collect()[0][0]
    assert raw == total


def test_scores_and_nesting(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG)
    t = f.tree
    s = t.where("performance_score IS NOT NULL").agg(F.min("performance_score"), F.max("performance_score")).collect()[0]
    assert 0 <= s[0] <= s[1] <= 100
    cre = t.where("level = 'creative'").select("campaign_key", "adset_key", F.col("leads").alias("cl"))
    ads = t.where("level = 'adset'").select("campaign_key", "adset_key", F.col("leads").alias("al"))
    camp = t.where("level = 'campaign'").select("campaign_key", F.col("leads").alias("pl"))
    j = cre.join(ads, ["campaign_key", "adset_key"]).join(camp, "campaign_key")
    assert j.where("cl > al OR al > pl").count() == 0


def test_independent_of_partitioning(spark):
    def snapshot():
        f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG)
        return sorted(tuple(r) for r in f.tree.collect())

    before = snapshot()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after = snapshot()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert before == after


def test_positions_over_many_tasks(spark):
    from pyspark.sql import functions as F

    from adfunnel.operators.rank import with_position

    df = spark.range(0, 5000, 1, 7).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.xxhash64("id") % 50).alias("v"), F.lit("clash").alias("_at"))
    rows = with_position(df, [F.col("v").desc_nulls_last(), F.col("id").asc()]).collect()
    want = sorted(((r.v, r.id) for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(r.v, r.id) for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1, 5001))
    assert with_position(df.limit(0), [F.col("id")]).count() == 0


def test_nested_export_in_bounded_chunks(spark):
    from helpers import CFG, ad, tables

    from adfunnel import Funnel
    from adfunnel.operators.hierarchy import nested_export, parsed_back

    ads = [ad(i, f"LEADS {'a' if i else 'b'}", f"s{i % 3}" if i % 5 else "", f"c{i}", 10) for i in range(40)] + [ad(99, "LEADS z", None, None, 1)]
    tree = Funnel(tables(spark, ads), CFG, materialize=True).tree
    nested = nested_export(tree, children=4)
    rows = nested.collect()
    assert max(len(r.children) for r in rows) == 4 and any(not r.children for r in rows)
    for r in rows:
        keys = [c.creative_key if r.level == "adset" else c.adset_key for c in r.children]
        assert keys == sorted(keys) and all(c.campaign_key == r.campaign_key for c in r.children)
    chunks = {}
    for r in rows:
        chunks.setdefault((r.level, r.campaign_key, r.adset_key), []).append(r.chunk)
    assert all(sorted(x) == list(range(len(x))) for x in chunks.values())
    cols = sorted(tree.columns)
    assert sorted(map(repr, parsed_back(nested).select(*cols).collect())) == sorted(map(repr, tree.select(*cols).collect()))
