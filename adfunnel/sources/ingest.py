"""Raw-table ingest: sheet-style headers -> canonical, typed columns.

Raw tables arrive with free-form headers and every cell as text.  Headers
are normalised (strip, lower, ' ' -> '_'), blank and repeated headers are
dropped (first kept), and each canonical column is resolved from an ordered
alias list.  All of this is metadata work on the plan: no data is touched
until an action runs.
"""

from __future__ import annotations

import csv
import logging
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ADS_REQUIRED, ALIASES
from ..functions.clean import guess_dates, parse_money, parse_number, with_date
from ..session import checkpoint_dir, path_exists
from .fixtures import FunnelTables

log = logging.getLogger(__name__)

# Canonical column types once cleaned.
_MONEY_COLS = {"spend", "revenue"}
_COUNT_COLS = {"impressions", "clicks", "reach"}
_TEXT_COLS = {"campaign", "adset", "creative", "email", "product", "origin"}


def normalize_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _first_wins(headers: list[str]) -> list[tuple[int, str]]:
    """(position, normalised name) of the columns to keep."""
    seen: set[str] = set()
    out = []
    for i, h in enumerate(headers):
        norm = normalize_header(h or "")
        if norm and norm not in seen:
            seen.add(norm)
            out.append((i, norm))
    return out


def normalize_headers(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rename columns to their normalised header; drop blank headers and
    later duplicates (first occurrence wins).  Columns listed in ``keep``
    (e.g. a row-order key) pass through untouched."""
    keep = [k for k in (keep or []) if k in df.columns]
    names = [c for c in df.columns if c not in keep]
    cols = [F.col(_quote(k)) for k in keep]
    cols += [F.col(_quote(names[i])).alias(n) for i, n in _first_wins(names) if n not in keep]
    return df.select(*cols)


def resolve(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str | None]:
    """canonical name -> first alias present among ``columns`` (or None)."""
    present = set(columns)
    return {canon: next((a for a in cands if a in present), None) for canon, cands in aliases.items()}


def select_canonical(df: DataFrame, aliases: dict[str, list[str]], keep: list[str] | None = None) -> DataFrame:
    """Project the resolved columns under their canonical names."""
    keep = keep or []
    mapping = resolve(df.columns, aliases)
    cols = [F.col(_quote(k)) for k in keep]
    cols += [F.col(_quote(src)).alias(canon) for canon, src in mapping.items() if src is not None]
    return df.select(*cols)


def require(mapping: dict[str, str | None], required: list[str], table: str) -> None:
    missing = [c for c in required if mapping.get(c) is None]
    if missing:
        raise ValueError(f"{table}: required columns not found: {', '.join(missing)}")


ROW_ORDER = "row_order"
_FILE_BITS = 43  # bytes of a file; the rest of a long numbers the files
_SMALL = 100_000  # rows of a table that is broadcast


@dataclass
class Sheet:
    """A sheet read from files: its rows, and the lines that are not rows (file, row_order, value, reason)."""

    rows: DataFrame
    quarantine: DataFrame | None = None


class RawTables(dict):
    """Raw tables by name; ``quarantine`` has the lines set aside, by name."""

    def __init__(self, *args):
        super().__init__(*args)
        self.quarantine: dict[str, DataFrame] = {}


def _landed(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of the files under ``path``, stored once.

    Files are split as the reader likes; ``block`` is where a split begins in
    its file, and ``at`` grows with the lines of a split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    target = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex[:12]}"
    lines.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(lines.schema).parquet(target)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of a known, small size; a larger one is joined by shuffle."""
    return F.broadcast(df) if rows <= _SMALL else df


def read_sheet(spark: SparkSession, path: str) -> Sheet:
    """CSV exports under ``path``, one record a line, each file with a header of its own.

    Headers are normalised and columns united by name, so files may order or
    leave out columns as they like; a missing cell is null.  Lines with more
    cells than their header, or with an open quote, are set aside with a reason.
    ``row_order`` numbers the rows by file (sorted by path) and place: the byte
    where the line's split begins plus the lines before it in the split, which
    grows within a file and needs no pass over the data and no single task.
    What comes to the driver is a row per split and a header per file, as many
    as its own listing of the files has.
    """
    lines = _landed(spark, path)
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first")).collect()
    if not splits:
        return Sheet(spark.createDataFrame([], T.StructType([])))
    rank = {f: i for i, f in enumerate(sorted({r.file for r in splits}))}
    heads = spark.createDataFrame([(r.first,) for r in splits if r.block == 0], "head long")
    heads = lines.join(_sized(heads, len(rank)), F.col("at") == F.col("head")).where("block = 0").select("file", "value").collect()
    header = {r.file: tuple(next(csv.reader([r.value.lstrip("\ufeff")]), [])) for r in heads}
    kinds = sorted(set(header.values()))
    places = [(r.file, r.block, (rank[r.file] << _FILE_BITS) + r.block - r.first, r.first if r.block == 0 else None, kinds.index(header[r.file])) for r in splits]
    places = spark.createDataFrame(places, "file string, block long, base long, head long, kind int")
    body = lines.join(_sized(places, len(splits)), ["file", "block"]).where("(head is null or at <> head) and trim(value) <> ''")

    # one record type per kind of header, with a cell more to see what doesn't fit
    cells = [", ".join(f"_c{i} string" for i in range(len(k) + 1)) for k in kinds]
    parsed = [F.when(F.col("kind") == i, F.from_csv("value", c, {"escape": '"'})).alias(f"k{i}") for i, c in enumerate(cells)]
    body = body.select("*", F.inline(F.array(F.struct(*parsed))))  # made once a row, whatever reads them (see ``once``)
    kinds_of = [f"k{i}" for i in range(len(kinds))]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    body = body.select("file", "value", (F.col("base") + F.col("at")).alias(ROW_ORDER), (quotes % 2 == 1).alias("open"), *kinds_of)
    many = reduce(lambda x, y: x | y, (F.coalesce(F.col(f"k{i}._c{len(k)}").isNotNull(), F.lit(False)) for i, k in enumerate(kinds)))
    reason = F.when(F.col("open"), "open quote").when(many, "more cells than headers")
    where: dict[str, list] = {}
    for i, k in enumerate(kinds):
        for c, name in _first_wins(list(k)):
            where.setdefault(name, []).append(F.col(f"k{i}._c{c}"))
    where.pop(ROW_ORDER, None)  # a sheet's own column of that name isn't the order of its rows
    body = body.withColumn("reason", reason)
    rows = body.where("reason is null").select(ROW_ORDER, *(F.coalesce(*cols).alias(name) for name, cols in where.items()))
    return Sheet(rows, body.where("reason is not null").select("file", ROW_ORDER, "value", "reason"))


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_sheet`` without their order."""
    rows = read_sheet(spark, path).rows
    return rows.drop(ROW_ORDER)


def read_multiline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exports whose cells hold line breaks.  Such a file can't be split: it is
    one task, and all files must have the header of the first."""
    first = spark.read.option("header", False).option("multiLine", True).csv(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    headers = [h if h is not None else "" for h in first[0]]
    positional = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(headers))])
    body = spark.read.schema(positional).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    return body.select(*[F.col(f"_c{i}").alias(n) for i, n in _first_wins(headers)])


def load_raw(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> RawTables:
    """Load the four raw tables; a missing path gives an empty table, any other failure raises.

    ``fmt``: "csv" (a record a line, splittable, with row_order and
    quarantine), "csv-multiline", or any format of Spark.
    """
    out = RawTables()
    for name in ALIASES:
        path = paths.get(name)
        if path is None or not path_exists(spark, path):  # missing sheet -> empty table, as the dashboard does
            log.error("table %s not found; using an empty table", name)
            df = spark.createDataFrame([], T.StructType([]))
        elif fmt == "csv":
            sheet = read_sheet(spark, path)
            df = sheet.rows
            if sheet.quarantine is not None:
                out.quarantine[name] = sheet.quarantine
        elif fmt == "csv-multiline":
            df = read_multiline_csv(spark, path)
        else:
            df = normalize_headers(spark.read.format(fmt).load(path))
        out[name] = df
    return out


@dataclass
class Resolution:
    """Which canonical columns each raw table provided."""

    mapping: dict[str, dict[str, str | None]] = field(default_factory=dict)

    def has(self, table: str, column: str) -> bool:
        return self.mapping.get(table, {}).get(column) is not None


def _typed(df: DataFrame, table: str, mapping: dict[str, str | None], keep: list[str], guess: bool = False) -> DataFrame:
    guess = guess and mapping.get("date") is not None
    if guess:
        df = guess_dates(df, [mapping["date"]])
    dated = "_dated" + "_" * max((len(c) for c in df.columns), default=0)
    if mapping.get("date") is not None and not guess:
        df = with_date(df, mapping["date"], dated)
    cols = [F.col(_quote(k)) for k in keep]
    for canon, src in mapping.items():
        if src is None:
            if canon in _MONEY_COLS:
                cols.append(F.lit(0).cast("decimal(38,6)").alias(canon))
            elif canon in _COUNT_COLS:
                cols.append(F.lit(0.0).alias(canon))
            elif canon == "date":
                cols.append(F.lit(None).cast("timestamp_ntz").alias(canon))
            else:
                cols.append(F.lit(None).cast("string").alias(canon))
            continue
        c = F.col(_quote(src))
        if canon == "date":
            cols.append((c if guess else F.col(dated)).alias(canon))
        elif canon in _MONEY_COLS:
            cols.append(parse_money(c).alias(canon))
        elif canon in _COUNT_COLS:
            cols.append(parse_number(c).alias(canon))
        else:
            cols.append(c.cast("string").alias(canon))
    return df.select(*cols)


def to_silver(raw: dict[str, DataFrame], keep: list[str] | None = None, guess: bool = False) -> tuple[FunnelTables, Resolution]:
    """Resolve and type the raw tables; absent optional columns become
    typed nulls / zeros and are reported in the :class:`Resolution`.  Columns
    in ``keep`` pass through; by default the row order of files does.  With
    ``guess`` a date column votes for the format of what the cascade leaves."""
    keep = [ROW_ORDER] if keep is None and ROW_ORDER in raw["ads"].columns else keep or []
    res = Resolution()
    typed = {}
    for name, aliases in ALIASES.items():
        df = raw[name]
        mapping = resolve([c for c in df.columns if c not in keep], aliases)
        res.mapping[name] = mapping
        if name == "ads" and len(set(df.columns) - set(keep)) > 0:
            require(mapping, ADS_REQUIRED, "ads")
        k = [c for c in keep if c in df.columns]
        typed[name] = _typed(df, name, mapping, k, guess)
    return FunnelTables(typed["ads"], typed["leads"], typed["appointments"], typed["sales"]), res
