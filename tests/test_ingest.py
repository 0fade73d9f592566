"""Header normalisation, alias resolution and CSV ingest."""

import pytest

from adfunnel.config import ADS_ALIASES
from adfunnel.sources import ingest as IN


def test_normalize_headers_first_wins(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "`Email` string, `Ad Set Name` string, `x` string, ` email ` string")
    out = IN.normalize_headers(df)
    assert out.columns == ["email", "ad_set_name", "x"]
    assert out.collect()[0]["email"] == "a"


def test_resolve_priority():
    cols = ["data", "campaign", "campanha", "spend_(cost,_amount_spent)", "impressoes", "cliques"]
    m = IN.resolve(cols, ADS_ALIASES)
    assert m["date"] == "data" and m["campaign"] == "campaign" and m["adset"] is None
    assert m["spend"] == "spend_(cost,_amount_spent)" and m["reach"] is None


def test_required_columns(spark):
    raw = {
        "ads": spark.createDataFrame([("2025-12-01", "X LEADS")], "date string, campaign string"),
        "leads": spark.createDataFrame([], "email string"),
        "appointments": spark.createDataFrame([], "email string"),
        "sales": spark.createDataFrame([], "email string"),
    }
    with pytest.raises(ValueError, match="spend"):
        IN.to_silver(raw)


def test_csv_with_dirty_headers(spark, tmp_path):
    p = tmp_path / "ads.csv"
    p.write_text(
        "Date,Campaign Name,Ad Set Name,Ad Name,Spend,Impressions,Clicks,,Campaign Name\n"
        "01/12/2025,  Promo LEADS ,A1,C1,\"R$ 1.234,56\",1000,10,junk,other\n"
        "2025-12-02,PROMO LEADS,A1,C1,100.5,500,5,junk,other\n",
        encoding="utf-8",
    )
    df = IN.read_sheet_csv(spark, str(p))
    assert df.columns == ["date", "campaign_name", "ad_set_name", "ad_name", "spend", "impressions", "clicks"]
    raw = {"ads": df}
    for name in ("leads", "appointments", "sales"):
        raw[name] = spark.createDataFrame([], "email string")
    silver, res = IN.to_silver(raw)
    assert res.has("ads", "campaign") and not res.has("ads", "reach")
    rows = silver.ads.orderBy("date").collect()
    assert [str(r.spend) for r in rows] == ["1234.560000", "100.500000"]
    assert rows[0].campaign == "  Promo LEADS " and rows[0].reach == 0.0


def test_missing_table_is_empty(spark, tmp_path):
    tables = IN.load_raw(spark, {"ads": str(tmp_path / "nope.csv")})
    assert all(len(t.columns) == 0 for t in tables.values())


def test_missing_path_is_empty_and_a_broken_file_raises(spark, tmp_path):
    import pytest as _pytest

    from adfunnel.sources.ingest import load_raw

    assert load_raw(spark, {"ads": f"{tmp_path}/none"})["ads"].columns == []
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    with _pytest.raises(Exception):
        load_raw(spark, {"ads": f"{tmp_path}/bad.parquet"}, fmt="parquet")


def _write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_each_file_has_a_header_of_its_own(spark, tmp_path):
    _write(tmp_path / "ads", "a.csv", "Date,Campaign Name,Spend\n2025-12-01,X LEADS,1\n")
    _write(tmp_path / "ads", "b.csv", "﻿Spend, campaign name ,,Date,Clicks,Spend\n\"2,5\",\"Y \"\"q\"\" LEADS\",junk,2025-12-02,7,99\n\n")
    _write(tmp_path / "ads", "c.csv", "Spend,Date\n")
    _write(tmp_path / "ads", "d.csv", "")
    df = IN.read_sheet_csv(spark, str(tmp_path / "ads"))
    got = {r.campaign_name: (r.date, r.spend, r.clicks) for r in df.collect()}
    assert got == {"X LEADS": ("2025-12-01", "1", None), 'Y "q" LEADS': ("2025-12-02", "2,5", "7")}


def test_broken_lines_are_set_aside(spark, tmp_path):
    _write(tmp_path / "leads", "a.csv", "Email,utm_campaign\na@x,A\nb@x,B,more\nc@x\n\"d@x,D\n,E\n")
    raw = IN.load_raw(spark, {"leads": str(tmp_path / "leads")})
    assert sorted(((r.email, r.utm_campaign) for r in raw["leads"].collect()), key=str) == [("a@x", "A"), ("c@x", None), (None, "E")]
    bad = raw.quarantine["leads"].collect()
    assert sorted((r.value, r.reason) for r in bad) == [('"d@x,D', "open quote"), ("b@x,B,more", "more cells than headers")]
    assert all(r.file.endswith("a.csv") for r in bad)


def test_row_order_over_files_and_splits(spark, tmp_path):
    """Rows are numbered in file order although every file is cut in many splits, and the first spelling follows."""
    from adfunnel import Funnel, FunnelConfig

    n = 0
    for f in ("a.csv", "b.csv", "c.csv"):
        head = "Date,Campaign Name,Spend,Impressions,Clicks,No\n" if f != "b.csv" else "No,Clicks,Impressions,Spend,Campaign Name,Date\n"
        body = []
        for _ in range(300):
            cells = ["2025-12-01", f"{'leads PRO' if n else 'Leads Pro'} c{n % 7}", "1", "10", "2", str(n)]
            body.append(",".join(cells if f != "b.csv" else cells[::-1]))
            n += 1
        _write(tmp_path / "ads", f, head + "\n".join(body) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        raw = IN.load_raw(spark, {"ads": str(tmp_path / "ads")})
        rows = raw["ads"].select("row_order", "no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.no) for r in sorted(rows, key=lambda r: r.row_order)] == list(range(n)) and len({r.row_order for r in rows}) == n
    silver, res = IN.to_silver(raw)
    assert "row_order" in silver.ads.columns
    names = Funnel(silver, FunnelConfig(date_start="2025-12-01", date_end="2025-12-31"), res).rollup.where("level = 'campaign'").select("campaign_key", "name").collect()
    assert dict(map(tuple, names)) == {"leads pro c0": "Leads Pro c0"} | {f"leads pro c{k}": f"leads PRO c{k}" for k in range(1, 7)}


def test_multiline_cells(spark, tmp_path):
    _write(tmp_path / "leads", "a.csv", 'Email,utm_campaign\na@x,"two\nlines"\n')
    raw = IN.load_raw(spark, {"leads": str(tmp_path / "leads")}, fmt="csv-multiline")
    assert [tuple(r) for r in raw["leads"].collect()] == [("a@x", "two\nlines")]
