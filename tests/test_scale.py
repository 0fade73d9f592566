"""What keeps a query's shuffles and parses in proportion to its input."""

import uuid

from pyspark.sql import functions as F

from adfunnel.config import DATE_FORMATS, FunnelConfig
from adfunnel.functions import clean
from adfunnel.operators import filters as FL
from adfunnel.session import checkpoint_dir
from adfunnel.sources import fixtures as FX
from adfunnel.sources import ingest as IN
from adfunnel.sources.fixtures import FunnelTables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _inputs(spark, root):
    """Line items with a repeated, a null and a dangling key."""
    day = "timestamp_ntz'1996-03-05 10:00:00'"
    li = spark.sql(
        "select * from values (1L, 1L, 1L, 1, 2D, 10D, 0.1D, 'R', 'F'), (1L, 1L, 1L, 1, 2D, 10D, 0.1D, 'R', 'F'), (2L, 2L, 1L, 2, 3D, 20D, 0D, 'A', 'O'), "
        "(null, 1L, 1L, 3, 1D, 5D, 0D, 'N', 'O'), (9L, 1L, 1L, 4, 1D, 5D, 0D, 'N', 'O') "
        "as t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus)"
    ).selectExpr("*", f"if(l_orderkey = 2, null, {day}) as l_shipdate")
    li.write.parquet(f"{root}/lineitem.parquet")
    orders = spark.sql("select * from values (1L, '1-URGENT', 'F'), (2L, '5-LOW', 'O') as t(o_orderkey, o_orderpriority, o_orderstatus)").selectExpr("*", f"{day} as o_orderdate")
    orders.write.parquet(f"{root}/orders.parquet")
    spark.sql("select * from values (1L, 'PROMO', 'Brand#9', 'ring'), (2L, 'SMALL', 'Brand#8', 'bolt') as t(p_partkey, p_type, p_brand, p_name)").write.parquet(f"{root}/part.parquet")
    return root


def test_stored_tables_come_of_one_join_without_a_further_shuffle(spark, tmp_path, monkeypatch):
    src = _inputs(spark, str(tmp_path / "in"))
    joins = []
    base = FX.base
    monkeypatch.setattr(FX, "base", lambda *a: joins.append(a) or base(*a))
    cls = type(spark.range(1))
    monkeypatch.setattr(cls, "repartitionByRange", lambda *a: (_ for _ in ()).throw(AssertionError("dealt again")))
    stored = FX.store_silver(spark, src)
    assert len(joins) == 1 and "SortMergeJoin" in plan(base(spark, src))
    live = FX.project_silver(spark, src)
    for name, df in stored.as_dict().items():
        want = live.as_dict()[name]
        assert df.drop(FL.MONTH).exceptAll(want).isEmpty() and want.exceptAll(df.drop(FL.MONTH)).isEmpty(), name
    assert stored.ads.count() == 3 and stored.ads.where(f"{FL.MONTH} is null").count() == 1
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stored.ads.inputFiles()[0].split('/ads/')[0]}/staging-*")
    assert not left.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(left)


def test_a_filter_on_a_parsed_date_cleans_its_text_once(spark):
    raw = {n: spark.createDataFrame([("1/2/2025", "x LEADS PRO", "1", "2", "3")], "date string, campaign_name string, spend string, impressions string, clicks string") for n in ("ads", "leads", "appointments", "sales")}
    silver, _ = IN.to_silver(raw)
    kept = FL.filter_ads(silver.ads, FunnelConfig(date_start="2025-01-01", date_end="2025-12-31"))
    assert plan(kept.select("date")).split("Scan")[0].count("regexp_replace(") == 1
    assert [str(r.date) for r in kept.collect()] == ["2025-02-01 00:00:00"]


def test_struct_fields_pass_by_a_parsed_date(spark):
    """Fields of a kept struct are read beside the date of several tables in one plan."""
    raw = spark.createDataFrame([((1, 2, 3), "1/2/2025", "a@x")], "ordinal struct<a:int,b:int,c:int>, data_entrada_agendamento string, email string")
    parts = []
    for _ in range(2):
        dated = clean.with_date(raw, "data_entrada_agendamento", "date")
        parts.append(dated.select("ordinal.a", "ordinal.b", "ordinal.c", "date", clean.norm_key("email").alias("email")))
    assert [(r.a, r.b, r.c, str(r.date), r.email) for r in parts[0].unionByName(parts[1]).collect()] == [(1, 2, 3, "2025-02-01 00:00:00", "a@x")] * 2


def test_texts_of_another_shape_are_not_tried(spark):
    texts = ["2025-12-01", "1/2/2025", "+12025-12-01", "005/1/2025", "1/2/2025 3:4:5", "1-2-2025", "1-2-2025 3:4:5", "2025-1-2 3:4:5", "2025-1-2t3:4:5", "-5/1/2025", "99-1-1", "n/a", "2025-12-01\n", "2025-12-01Z", "31/02/2025", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    formats = [f for f, _ in DATE_FORMATS]
    plain = F.coalesce(*(F.try_to_timestamp(F.concat(clean._cleaned_date("t"), F.lit("Z")), F.lit(f + "X")) for f in formats))
    got = df.select(clean.parse_date("t").isNotNull().alias("got"), plain.isNotNull().alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and sum(r.got for r in got) >= 8
    tried = [[f for f in formats if df.where(F.col("t") == t).where(F.col("t").rlike(clean._shape(f))).count()] for t in ("1/2/2025", "1-2-2025", "n/a")]
    assert tried == [["d/M/yyyy"], ["d-M-yyyy"], []]


def test_exported_sheets_are_packed_and_read_back(spark, tmp_path):
    src = _inputs(spark, str(tmp_path / "in"))
    paths = FX.exported_csv(spark, src)
    files = [f for p in paths.values() for f in spark.read.text(p).inputFiles()]
    assert files and all(f.endswith(".gz") for f in files)
    silver, _ = IN.to_silver(IN.load_raw(spark, paths))
    assert silver.ads.count() == 3 and silver.leads.count() == 3


def test_refresh_takes_rows_in_and_finds_buckets_without_dealing_them(spark, tmp_path, monkeypatch):
    from adfunnel.plans.funnel import Funnel
    from adfunnel.streaming import state as ST
    from adfunnel.streaming.refresh import start_ingest

    t = FX.silver_tables(spark, _inputs(spark, str(tmp_path / "in")))
    t.sales.drop(FL.MONTH).write.parquet(f"{tmp_path}/sales")
    cls = type(spark.range(1))
    dealt = []
    repartition = cls.repartition
    monkeypatch.setattr(cls, "repartition", lambda self, *a: dealt.append(a) or repartition(self, *a))
    q = start_ingest(spark, "sales", f"{tmp_path}/sales", t.sales.drop(FL.MONTH).schema, f"{tmp_path}/work", available_now=True)
    q.awaitTermination()
    assert not dealt and spark.read.parquet(f"{tmp_path}/work/stored/sales").count() == t.sales.count()

    seen = []
    touched = ST._touched
    monkeypatch.setattr(ST, "_touched", lambda frames: seen.append(([plan(f) for f in frames], touched(frames))) or seen[-1][1])
    new = Funnel(FunnelTables(*(df.drop(FL.MONTH) for df in t.as_dict().values())), FX.FIXTURE_CONFIG)
    state = ST.State(spark, f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex[:8]}", (), 8)
    ST.merge(state, 0, new)
    (plans, buckets), = seen
    assert not any("Exchange" in p for p in plans)
    pairs = [state.with_bucket(RU) for RU in (ST.RU.lead_level_emails(new.leads_f), new.appt_pairs, new.sale_pairs)]
    assert buckets == touched(pairs)


def test_a_lead_is_shuffled_as_one_row_and_its_levels_not_again(spark):
    """Levels are made after the last exchange of the leads, and the outcome of an e-mail is joined without another one."""
    from adfunnel.operators import rollup as RU

    rows = [("A@x ", "c1", "a1", "r1"), ("a@x", " C1", "a1", "r1"), ("a@x", "c1", "a2", ""), ("b@x", "c1", None, "r1"), ("b@x", None, "a1", "r1"), (None, "c1", "a1", "r1"), ("", "c1", "a1", "r1"), ("", "c2", "a1", "r1")]
    leads = spark.createDataFrame(rows * 2, "email string, campaign string, adset string, creative string")
    levels = RU.lead_level_emails(leads)
    want = {tuple(r) for r in RU.lead_level_rows(leads).collect()}
    got = [tuple(r) for r in levels.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 14
    assert "Exchange" not in plan(levels).split("Generate")[0]

    appts = spark.createDataFrame([("c1", "a@x"), ("c2", "")], "campaign_key string, email string")
    sales = spark.createDataFrame([("c1", "a@x", 5)], "campaign_key string, email string, revenue int").withColumn("revenue", F.col("revenue").cast(clean.MONEY))
    facts = RU.lead_facts(levels, RU.email_summary(appts, sales).hint("merge"))
    between = plan(facts).split("SortMergeJoin")[1].split("Generate")[0]
    assert "Exchange" not in between
    found = {tuple(r)[:4]: (r.leads, r.appointments, r.sales, float(r.revenue)) for r in facts.collect()}
    assert found[RU.TOTALS_LEVEL, None, None, None] == (3, 2, 1, 5.0)
    assert found["campaign", "c1", None, None] == (3, 2, 1, 5.0) and found["campaign", "c2", None, None] == (1, 1, 0, 0.0)
    assert found["adset", "c1", "a2", None] == (1, 1, 1, 5.0) and ("creative", "c1", "a2", "") not in found


def test_splits_are_smaller_only_while_the_tables_are_stored(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for held, meanwhile in (("134217728b", 64 << 20), ("1g", 64 << 20), ("16MB", 16 << 20), ("5000", 5000)):
            spark.conf.set(key, held)
            with FX.smaller_splits(spark):
                assert spark.conf.get(key) == str(meanwhile)
            assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, before)
