"""Consolidated views made in one pass, the level view's fall-back, what a run leaves behind."""

import os

from adfunnel import Funnel
from adfunnel.operators import hierarchy as H
from adfunnel.session import checkpoint_dir
from adfunnel.sources.fixtures import FIXTURE_CONFIG, silver_tables

from helpers import CFG, ad, tables

SF = "/root/testdata/sf0.001"


def canon(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_three_views_in_one_pass(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG, materialize=True)
    both = f._pin(H.consolidate(f.tree, H.LEVELS, store=f._pin))
    assert both.columns == ["root", *H.FLAT_COLUMNS]
    for root in H.LEVELS:
        assert canon(both.where(both.root == root).drop("root")) == canon(H.consolidate(f.tree, root)), root


def test_tree_is_read_once(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG, materialize=True)
    plan = H.consolidated_rows(f.tree, H.LEVELS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("HashAggregate") + plan.count("SortAggregate") == 2  # partial and final
    stored = f._pin(H.consolidated_rows(f.tree, H.LEVELS))
    scored = H.consolidate(f.tree, H.LEVELS, store=lambda _: stored)._jdf.queryExecution().executedPlan().toString()
    assert sum(" Join " in line or "Join " in line.strip(" +-:") for line in scored.splitlines()) == 1


def test_level_view_falls_back_to_the_tree(spark):
    f = Funnel(tables(spark, [ad(1, "Camp LEADS PRO", "", "", 10)]), CFG, materialize=True)
    assert f.level_view("campaign").columns == H.FLAT_COLUMNS
    for level in ("all", "nothing"):
        assert f.level_view(level).columns == f.tree.columns
    empty = Funnel(tables(spark, []), CFG, materialize=True)
    assert empty.level_view("adset").columns == empty.tree.columns


def test_level_view_plans_one_view(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG, materialize=True)
    f.level_view("adset")
    assert "adsets_flat" in f.__dict__ and not {"campaigns_flat", "creatives_flat"} & f.__dict__.keys()


def test_close_leaves_no_folder(spark):
    f = Funnel(silver_tables(spark, SF), FIXTURE_CONFIG, materialize=True)
    f.kpis.collect()
    folder = f"{checkpoint_dir(spark)}/funnel-{f._run_id}".removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    f.close()
    assert not os.path.exists(folder)
