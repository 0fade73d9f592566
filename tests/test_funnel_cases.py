"""The dashboard's quirks, each on a hand-written case (values worked out by hand)."""

import datetime as dt

from pyspark.sql import functions as F

from adfunnel import Funnel
from helpers import CFG, ad, appt, lead, rows, sale, tables


def tree_row(f, level, name):
    return [r for r in rows(f.tree) if r["level"] == level and r["name"] == name][0]


def test_two_attribution_models(spark):
    t = tables(
        spark,
        [ad(1, "C1 LEADS PRO", "A1", "X", 10), ad(2, "C1 LEADS PRO", "A2", "X", 10)],
        leads=[lead("e1", "C1 LEADS PRO", "A1", "X"), lead("e1", "C1 LEADS PRO", "A2", "X")],
        sales=[sale("e1", 100, "C2 LEADS PRO")],
    )
    f = Funnel(t, CFG)
    assert tree_row(f, "adset", "A1")["revenue"] == 100.0
    assert tree_row(f, "adset", "A2")["revenue"] == 100.0
    camp = tree_row(f, "campaign", "C1 LEADS PRO")
    assert (camp["leads"], camp["sales"], camp["revenue"]) == (1, 0, 0.0)


def test_equal_revenues_are_not_collapsed(spark):
    t = tables(
        spark,
        [ad(1, "C1 LEADS PRO", "A1", "X", 10)],
        leads=[lead("e1", "C1 LEADS PRO", "A1", "X"), lead("e2", "C1 LEADS PRO", "A1", "X")],
        sales=[sale("e1", 100, "C1 LEADS PRO"), sale("e2", 100, "C1 LEADS PRO")],
    )
    f = Funnel(t, CFG)
    assert tree_row(f, "adset", "A1")["revenue"] == 200.0
    assert tree_row(f, "campaign", "C1 LEADS PRO")["revenue"] == 200.0


def test_blank_adset_row_has_no_leads(spark):
    t = tables(spark, [ad(1, "C1 LEADS PRO", "", "X", 10)], leads=[lead("e1", "C1 LEADS PRO", "", "X")])
    f = Funnel(t, CFG)
    adset = tree_row(f, "adset", "")
    assert adset["leads"] == 0
    assert tree_row(f, "campaign", "C1 LEADS PRO")["leads"] == 1


def test_single_creative_scores(spark):
    both = tables(
        spark,
        [ad(1, "C1 LEADS PRO", "A1", "X", 10)],
        leads=[lead("e1", "C1 LEADS PRO", "A1", "X")],
        sales=[sale("e1", 50, "C1 LEADS PRO")],
    )
    assert tree_row(Funnel(both, CFG), "creative", "X")["performance_score"] == 50
    ctr_only = tables(spark, [ad(1, "C1 LEADS PRO", "A1", "X", 10)])
    x = tree_row(Funnel(ctr_only, CFG), "creative", "X")
    assert (x["performance_score"], x["score_band"]) == (10, "critical")


def test_no_leads_drops_cpl_weight(spark):
    t = tables(
        spark,
        [ad(1, "C1 LEADS", "A1", "X", 10, clicks=10.0), ad(2, "C1 LEADS", "A1", "Y", 10, clicks=20.0)],
        sales=[],
    )
    f = Funnel(t, CFG)
    # no revenue, no leads: only CTR counts (0.20); X is the minimum, Y the maximum
    assert tree_row(f, "creative", "X")["performance_score"] == 0
    assert tree_row(f, "creative", "Y")["performance_score"] == 20


def test_consolidation_does_not_dedupe(spark):
    t = tables(
        spark,
        [ad(1, "C1 LEADS PRO", "A1", "X", 10), ad(2, "C2 LEADS PRO", "A1", "X", 30)],
        leads=[lead("e1", "C1 LEADS PRO", "A1", "X"), lead("e1", "C2 LEADS PRO", "A1", "X")],
    )
    f = Funnel(t, CFG)
    x = [r for r in rows(f.creatives_flat) if r["id"] == "x"][0]
    assert (x["leads"], x["spend"], x["cpl"]) == (2, 40.0, 20.0)
    a1 = [r for r in rows(f.adsets_flat) if r["depth"] == 0][0]
    assert a1["leads"] == 2


def test_bottom_is_reversed_when_few(spark):
    t = tables(
        spark,
        [ad(1, "C1 LEADS", "A1", "X", 10, clicks=10.0), ad(2, "C1 LEADS", "A1", "Y", 10, clicks=20.0),
         ad(3, "C1 LEADS", "A1", "Z", 10, clicks=15.0)],
    )
    f = Funnel(t, CFG)
    top = [r["name"] for r in rows(f.top_creatives, "rank")]
    bottom = [r["name"] for r in rows(f.bottom_creatives, "rank")]
    assert top == ["Y", "Z", "X"] and bottom == list(reversed(top))


def test_alert_kept_once_per_entity_and_metric(spark):
    t = tables(
        spark,
        [ad(1, "Z LEADS PRO", "Z LEADS PRO", "Q", 100)],
        leads=[lead("e1", "Z LEADS PRO", "Z LEADS PRO", "Q")],
        sales=[sale("e1", 50, "Z LEADS PRO")],
    )
    f = Funnel(t, CFG)
    alerts = rows(f.alerts, "position")
    roas = [a for a in alerts if a["metric"] == "ROAS"]
    assert [(a["entity"], a["level"]) for a in roas] == [("Z LEADS PRO", "campaign"), ("Q", "creative")]
    assert roas[0]["value"] == "0.50x"


def test_campaign_filter_keeps_kpis(spark):
    t = tables(spark, [ad(1, "Big LEADS", "A", "X", 10), ad(2, "Small LEADS", "B", "Y", 20)])
    f = Funnel(t, CFG)
    sub = f.tree_filtered("big")
    assert {r["campaign_key"] for r in rows(sub)} == {"big leads"}
    assert rows(f.kpis)[0]["total_spend"] == 30.0


def test_date_edges(spark):
    end = dt.datetime(2025, 12, 31)
    t = tables(
        spark,
        [ad(1, "C LEADS PRO", "A", "X", 10, date=end), ad(2, "C LEADS PRO", "A", "X", 5, date=end.replace(hour=10))],
        leads=[lead("e1", "C LEADS PRO", "A", "X", date=end.replace(hour=10))],
    )
    f = Funnel(t, CFG)
    camp = tree_row(f, "campaign", "C LEADS PRO")
    assert (camp["spend"], camp["leads"]) == (10.0, 1)


def test_empty_payload_without_campaign_column(spark):
    schema = "row_order long, date timestamp_ntz, campaign_label string, adset string, creative string, spend decimal(38,6), impressions double, clicks double, reach double"
    t = tables(spark, [ad(1, "C LEADS", "A", "X", 10)], leads=[lead("e1", "C LEADS PRO", "A", "X")], ads_schema=schema)
    f = Funnel(t, CFG)
    k = rows(f.kpis)[0]
    assert k["total_spend"] == 0.0 and k["total_leads"] == 0
    assert f.tree.count() == 0


def test_first_spelling_wins(spark):
    t = tables(spark, [ad(5, "c leads", "a", "x", 1), ad(2, " C Leads ", "A", "X", 1), ad(9, "C LEADS", "A", "X", 1)])
    f = Funnel(t, CFG)
    names = {r["level"]: r["name"] for r in rows(f.tree)}
    assert names == {"campaign": "C Leads", "adset": "A", "creative": "X"}
