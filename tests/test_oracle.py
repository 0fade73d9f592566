"""A sample of registered queries against their DuckDB SQL at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "kpis", "performance_tree", "campaigns_flat", "adsets_flat_children", "top_creatives",
    "rule_alerts", "recommendations", "digest_lines", "sales_segment_filter", "leads_by_level",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if v is None:
            return "\x00null"
        if isinstance(v, float):
            return "\x00nan" if math.isnan(v) else repr(v)
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "performance_score" in df.columns
