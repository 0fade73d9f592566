"""Funnel tables derived from the driver's TPC-H-style tables.

The driver ships ``lineitem``, ``orders`` and ``part`` but no ad-delivery or
CRM data, so the four funnel tables are projected from
``base = lineitem ⋈ orders ⋈ part``.  Every projection is a plain
DataFrame plan over the whole tables: its cost grows with the data.

* campaign  = p_type + a suffix that decides which keyword filters it passes
* ad set    = p_brand, creative = p_name
* e-mail    = 'lead' || l_orderkey (one person per order)
* ordinal   = a unique row identity (struct of lineitem fields)
* row_order = l_orderkey * 8 + l_linenumber, the row position that decides
  which spelling of a key is shown first (ties: least spelling)

Two renderings exist: *silver* (typed, canonical column names) which the
funnel consumes directly, and *bronze* (everything text, sheet-style headers,
mixed date / number / key spellings) which exercises ingest and cleaning.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import weakref
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import FunnelConfig
from ..functions.clean import MONEY
from ..operators import filters as FL

# Reporting window the fixture data falls into.
FIXTURE_CONFIG = FunnelConfig(date_start="1996-01-01", date_end="2000-12-31")

_LINEITEM_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
]
_ORDERS_COLS = ["o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]
_PART_COLS = ["p_partkey", "p_type", "p_brand", "p_name"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ part with only the columns the funnel uses."""
    li = read_table(spark, sf_dir, "lineitem").select(*_LINEITEM_COLS)
    o = read_table(spark, sf_dir, "orders").select(*_ORDERS_COLS)
    p = read_table(spark, sf_dir, "part").select(*_PART_COLS)
    # orders grow with lineitem: merged at every size, so that no larger input turns to another plan
    return li.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        p, F.col("l_partkey") == F.col("p_partkey")
    )


def _campaign() -> Column:
    t = F.col("p_type")
    suffix = (
        F.when(t.contains("PROMO"), F.lit(" BRAND PRO"))
        .when(t.contains("SMALL"), F.lit(" LEADS"))
        .otherwise(F.lit(" LEADS PRO"))
    )
    return F.concat(t, suffix)


def _ordinal() -> Column:
    return F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    ).alias("ordinal")


def _row_order() -> Column:
    """Source row position as one long (ties are broken by the spelling)."""
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_order")


def _dec2(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _email() -> Column:
    return F.concat(F.lit("lead"), F.col("l_orderkey").cast("string"))


def is_lead() -> Column:
    brand_ok = ~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") | (F.col("l_linenumber") == 1)
    return F.col("l_returnflag").isin("A", "R") & brand_ok


def is_appointment() -> Column:
    economy = F.col("p_type").contains("ECONOMY")
    pri = F.col("o_orderpriority")
    return (
        (F.col("l_returnflag") == "R")
        & (pri != "5-LOW")
        & (~economy | (pri == "1-URGENT"))
    )


def is_sale() -> Column:
    economy = F.col("p_type").contains("ECONOMY")
    pri = F.col("o_orderpriority")
    return (
        (F.col("l_returnflag") == "R")
        & (F.col("l_linestatus") == "F")
        & (F.col("l_linenumber") <= 2)
        & pri.isin("1-URGENT", "2-HIGH")
        & (~economy | (pri == "1-URGENT"))
    )


def _product() -> Column:
    return (
        F.when(F.col("o_orderstatus") == "P", F.lit("Mentoria Basic"))
        .when(F.col("l_linenumber") == 2, F.lit(" mentoria optical pro "))
        .otherwise(F.lit("Mentoria Optical PRO"))
    )


def _origin() -> Column:
    return F.when(
        (F.col("o_orderpriority") == "2-HIGH") & (F.col("l_linenumber") == 1), F.lit("Orgânico")
    ).otherwise(F.lit("Tráfego Pago"))


@dataclass
class FunnelTables:
    """The four funnel inputs (typed "silver" form unless stated)."""

    ads: DataFrame
    leads: DataFrame
    appointments: DataFrame
    sales: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "ads": self.ads,
            "leads": self.leads,
            "appointments": self.appointments,
            "sales": self.sales,
        }


def silver_tables(spark: SparkSession, sf_dir: str, with_segments: bool = True, stored: bool = True) -> FunnelTables:
    """Typed funnel tables with canonical column names.

    ``stored=True`` reads them from Parquet written once per input folder
    (see :func:`store_silver`), as a deployment reads its stored tables;
    ``stored=False`` returns the live projection plan.
    """
    if stored and with_segments:
        return store_silver(spark, sf_dir)
    return project_silver(spark, sf_dir, with_segments)


def _input_fingerprint(sf_dir: str) -> str:
    h = hashlib.sha1(os.path.abspath(sf_dir).encode())
    for name in ("lineitem", "orders", "part"):
        try:
            st = os.stat(f"{sf_dir}/{name}.parquet")
            h.update(f"{name}:{st.st_size}:{st.st_mtime_ns}".encode())
        except OSError:
            h.update(name.encode())
    return h.hexdigest()[:16]


# per session, the handles of stored tables: their partitions are listed once, as they don't change any more
_STORED: weakref.WeakKeyDictionary[SparkSession, dict[str, FunnelTables]] = weakref.WeakKeyDictionary()


@contextmanager
def smaller_splits(spark: SparkSession, mb: int = 64):
    """Files are read in splits of at most ``mb`` MB meanwhile: packed rows take
    many times their bytes in a sort, which spills with the default splits."""
    key = "spark.sql.files.maxPartitionBytes"
    held = spark.conf.get(key)
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", held.lower()).groups()
    spark.conf.set(key, str(min(int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit, 0), mb << 20)))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def store_silver(spark: SparkSession, sf_dir: str) -> FunnelTables:
    """Write the projected funnel tables once (Parquet, in the cluster's
    checkpoint folder) and read them back.  A later call for the same,
    unchanged input folder reuses the stored tables.

    The join runs once, into a staging table; the four tables are filters and
    projections of it, so every task writes its rows by month without another
    shuffle.
    """
    from ..session import checkpoint_dir, remove

    root = f"{checkpoint_dir(spark)}/silver-months-{_input_fingerprint(sf_dir)}"
    held = _STORED.setdefault(spark, {})
    if root in held:
        return held[root]
    marker = f"{root}/complete-marker"
    try:
        done = spark.read.parquet(marker).count() == 1
    except Exception:  # not written yet (path does not exist)
        done = False
    joined = base(spark, sf_dir)
    live = _projected(joined).as_dict()
    if not done:
        staging = f"{root}/staging-{uuid.uuid4().hex[:12]}"
        joined.write.option("compression", "zstd").parquet(staging)
        # by month and day: a window opens its months only, and of these the row groups with its days
        with smaller_splits(spark):
            for name, df in _projected(spark.read.schema(joined.schema).parquet(staging)).as_dict().items():
                dealt = df.withColumn(FL.MONTH, FL.month_of(F.col("date"))).sortWithinPartitions(FL.MONTH, "date")
                dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(FL.MONTH).parquet(f"{root}/{name}")
        # written last: a crash before this point leaves no marker and the
        # tables are rewritten on the next call
        spark.range(1).write.mode("overwrite").parquet(marker)
        remove(spark, staging)
    # with the schema at hand a month stays text
    schemas = {name: StructType([*df.schema.fields, StructField(FL.MONTH, StringType())]) for name, df in live.items()}
    held[root] = FunnelTables(*[spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in schemas.items()])
    return held[root]


def project_silver(spark: SparkSession, sf_dir: str, with_segments: bool = True) -> FunnelTables:
    """The projection plan itself (lineitem ⋈ orders ⋈ part -> four tables)."""
    return _projected(base(spark, sf_dir), with_segments)


def _projected(b: DataFrame, with_segments: bool = True) -> FunnelTables:
    """The four tables as filters and projections of the joined rows."""
    keys = [_campaign().alias("campaign"), F.col("p_brand").alias("adset"), F.col("p_name").alias("creative")]
    ads = b.select(
        _ordinal(),
        _row_order(),
        F.col("l_shipdate").alias("date"),
        *keys,
        (_dec2("l_extendedprice") * _dec2("l_discount")).cast(MONEY).alias("spend"),
        (F.col("l_quantity") * 100).alias("impressions"),
        (F.col("l_linenumber") * 10).cast("double").alias("clicks"),
        (F.col("l_quantity") * 60).alias("reach"),
    )
    leads = b.where(is_lead()).select(
        _ordinal(), F.col("o_orderdate").alias("date"), _email().alias("email"), *keys
    )
    appointments = b.where(is_appointment()).select(
        _ordinal(), F.col("l_shipdate").alias("date"), _email().alias("email"), *keys
    )
    sale_cols = [
        _ordinal(),
        F.col("l_shipdate").alias("date"),
        _email().alias("email"),
        (_dec2("l_extendedprice") * (F.lit(1) - _dec2("l_discount"))).cast(MONEY).alias("revenue"),
        *keys,
    ]
    if with_segments:
        sale_cols += [_product().alias("product"), _origin().alias("origin")]
    sales = b.where(is_sale()).select(*sale_cols)
    return FunnelTables(ads, leads, appointments, sales)


# ---------------------------------------------------------------------------
# Bronze: everything rendered as text with sheet-style headers.
# The spelling of each value is chosen by l_linenumber % 4.
# ---------------------------------------------------------------------------

def _variant() -> Column:
    return F.col("ordinal.l_linenumber") % 4


def render_date(ts: Column) -> Column:
    v = _variant()
    return (
        F.when(v == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(v == 1, F.date_format(ts, "d/M/yyyy"))
        .when(v == 2, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .otherwise(F.concat(F.lit("'"), F.date_format(ts, "dd-MM-yyyy"), F.lit("'")))
    )


def render_mixed_date(ts: Column) -> Column:
    """Like ``render_date``, but some cells are typed as other programs show dates."""
    line = F.col("ordinal.l_linenumber")
    return (
        F.when(line == 5, F.date_format(ts, "yyyy/MM/dd"))
        .when(line == 6, F.date_format(ts, "MMM d, yyyy"))
        .when(line == 7, F.lit("n/a"))
        .otherwise(render_date(ts))
    )


def render_money(x: Column) -> Column:
    v = _variant()
    us = F.format_number(x.cast("double"), 4)
    br = F.translate(us, ",.", ".,")
    return (
        F.when(v == 0, F.regexp_replace(us, ",", ""))
        .when(v == 1, us)
        .when(v == 2, br)
        .otherwise(F.concat(F.lit("R$ "), br))
    )


def render_key(x: Column) -> Column:
    v = _variant()
    return (
        F.when(v == 0, x)
        .when(v == 1, F.upper(x))
        .when(v == 2, F.concat(F.lit("  "), x, F.lit(" ")))
        .otherwise(F.concat(x, F.lit("\t")))
    )


def render_count(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def bronze_tables(spark: SparkSession, sf_dir: str) -> FunnelTables:
    """All-text funnel tables with the headers a spreadsheet export has."""
    s = silver_tables(spark, sf_dir)
    ads = s.ads.select(
        "ordinal",
        "row_order",
        render_date(F.col("date")).alias("Date"),
        render_key(F.col("campaign")).alias("Campaign Name"),
        render_key(F.col("adset")).alias("Ad Set Name"),
        render_key(F.col("creative")).alias("Ad Name"),
        render_money(F.col("spend")).alias("Spend (Cost, Amount Spent)"),
        render_count(F.col("impressions")).alias("Impressions"),
        render_count(F.col("clicks")).alias("Clicks"),
        render_count(F.col("reach")).alias("Reach"),
    )
    leads = s.leads.select(
        "ordinal",
        render_date(F.col("date")).alias("Data Padrão"),
        render_key(F.col("email")).alias("Qual é o e-mail você mais utiliza?"),
        render_key(F.col("campaign")).alias("utm_campaign"),
        render_key(F.col("adset")).alias("utm_medium"),
        render_key(F.col("creative")).alias("utm_content"),
    )
    appointments = s.appointments.select(
        "ordinal",
        render_date(F.col("date")).alias("Data Entrada Agendamento"),
        render_key(F.col("email")).alias("Email"),
        render_key(F.col("campaign")).alias("utm_campaign"),
    )
    sales = s.sales.select(
        "ordinal",
        render_date(F.col("date")).alias("Data Compra"),
        render_key(F.col("email")).alias("E-mail Lead"),
        render_money(F.col("revenue")).alias("Valor Total da Venda (Ticket)"),
        render_key(F.col("campaign")).alias("utm_campaign"),
        F.col("product").alias("Produto"),
        F.col("origin").alias("Origem Macro"),
    )
    return FunnelTables(ads, leads, appointments, sales)


def mixed_lead_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text leads with cells in their date column that the cascade can't read."""
    leads = silver_tables(spark, sf_dir).leads
    return leads.select("ordinal", render_mixed_date(F.col("date")).alias("Data Padrão"), render_key(F.col("campaign")).alias("utm_campaign"))


def exported_csv(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The text tables as CSV files, as a spreadsheet exports them: sorted by
    source row, the later half of the files with its columns the other way
    round, each file packed (and so read by one task; there are as many as the
    sort has parts).  Returns a path per table."""
    from ..session import checkpoint_dir

    root = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex[:12]}"
    out = {}
    for name, df in bronze_tables(spark, sf_dir).as_dict().items():
        key = F.col("ordinal.l_orderkey")
        half = df.agg(F.avg(key).alias("half")).first().half or 0  # one number
        order = [F.col("row_order")] if "row_order" in df.columns else [key, F.col("ordinal.l_linenumber")]
        text = [c for c in df.columns if c not in ("ordinal", "row_order")]
        order += [F.col(f"`{c}`") for c in text if c in ("Campaign Name", "Ad Set Name", "Ad Name")]
        for part, rows, cols in (("1", key < half, text), ("2", key >= half, text[::-1])):
            sheet = df.where(rows).orderBy(*order).select(*(F.col(f"`{c}`") for c in cols))
            options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "compression": "gzip"}
            sheet.write.options(**options).csv(f"{root}/{name}/{part}")
        out[name] = f"{root}/{name}/*"
    return out
