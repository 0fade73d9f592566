"""Column expressions for cleaning loosely typed text (all JVM-side, no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE_FORMATS, GUESS_FORMATS, WHITESPACE_CHARS

MONEY = "decimal(38,6)"

_EDGE_QUOTES = "^['\"]+|['\"]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Remove leading/trailing whitespace the way Python's ``str.strip`` does
    (tabs, NBSP and the other Unicode spaces too; plain ``trim`` only removes
    ' ').  ``trim(str, chars)`` works on the UTF-8 bytes directly, without the
    string conversions a regex replacement costs per row."""
    return F.trim(_c(col), F.lit(WHITESPACE_CHARS))


def norm_key(col) -> Column:
    """Join key: stripped and lower-cased."""
    return F.lower(strip_ws(col))


def norm_upper(col) -> Column:
    """Segment value for equality tests: stripped and upper-cased."""
    return F.upper(strip_ws(col))


def _cleaned_date(col) -> Column:
    return F.regexp_replace(strip_ws(col), _EDGE_QUOTES, "")


def _shape(fmt: str) -> str:
    """A regex that every text of the format ``fmt`` matches: signs, digits and letters where its fields are."""
    out = []
    for quoted, field, _, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|(.)", fmt):
        if quoted:
            out.append(f"(?i:{re.escape(quoted)})")
        elif field:
            out.append({"yyyy": "[+-]?[0-9]{4,}", "MMM": "[^0-9]+"}.get(field, "[+-]?[0-9]+"))
        else:
            out.append(re.escape(other))
    return f"^{''.join(out)}$"


def _as_ntz(cleaned: Column, formats: list[str]) -> Column:
    # read as UTC and counted from the epoch, so that no session zone's clock change moves a date; a text of another
    # shape isn't tried, as a failing parse costs many times a reading one
    tries = [F.when(cleaned.rlike(_shape(f)), F.try_to_timestamp(F.concat(cleaned, F.lit("Z")), F.lit(f + "X"))) for f in formats]
    seconds = (F.unix_micros(F.coalesce(*tries)) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def parse_date(col) -> Column:
    """Text -> TIMESTAMP_NTZ via a fixed cascade of day-first formats.

    Whitespace, then single/double quotes are removed from both ends; the
    first format that parses wins; anything else is null.
    """
    return _as_ntz(_cleaned_date(col), [f for f, _ in DATE_FORMATS])


def once(value: Column) -> Column:
    """``value`` as a column made once a row: a filter on it reads what was
    made, where one on a plain projection makes the value again for every use."""
    return F.explode(F.array(value))


def with_date(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``parse_date`` of ``column`` as ``name``, its text made and cleaned once a row."""
    text = "_text" + "_" * max(len(c) for c in df.columns)
    cleaned = df.select("*", once(_cleaned_date(_named(column))).alias(text))
    return cleaned.select(*(_named(c) for c in df.columns), _as_ntz(F.col(text), [f for f, _ in DATE_FORMATS]).alias(name))


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def guess_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the text of each of ``columns`` as a date: the cascade, and
    where it fails the one format that the column votes for.

    Every text that the cascade leaves votes for each of ``GUESS_FORMATS`` that
    reads it; the format with most votes wins, the earlier one in a tie, and
    reads the others too. The votes are counts over the whole column, so they
    don't depend on the order of rows. They are one row, which is broadcast.
    An empty column, or one without a vote, has nulls where the cascade fails.
    """
    formats = [f for f, _ in GUESS_FORMATS]
    votes = []
    for i, c in enumerate(columns):
        text = _cleaned_date(_named(c))
        left = parse_date(_named(c)).isNull()
        counts = [F.count(F.when(left & _as_ntz(text, [f]).isNotNull(), 1)) for f in formats]
        # a greater count first, then an earlier format
        ballot = F.array(*(F.struct(n.alias("n"), F.lit(-k).alias("k")) for k, n in enumerate(counts)))
        best = F.array_max(ballot)
        votes.append(F.when(best["n"] > 0, -best["k"]).alias(f"_vote{i}"))
    out = df.crossJoin(F.broadcast(df.agg(*votes)))
    made = {}
    for i, c in enumerate(columns):
        text = _cleaned_date(_named(c))
        guessed = F.coalesce(*(F.when(F.col(f"_vote{i}") == k, _as_ntz(text, [f])) for k, f in enumerate(formats)))
        made[c] = F.coalesce(parse_date(_named(c)), guessed)
    return out.select(*(made[c].alias(c) if c in made else _named(c) for c in df.columns))


def _number_text(col) -> Column:
    """Digits with the decimal separator normalised to '.'.

    Everything but digits, ',' and '.' is dropped (sign, currency, '%').
    If a comma comes after the last dot the text is Brazilian (dots group
    thousands, the comma is decimal); otherwise commas group thousands.
    """
    kept = F.regexp_replace(_c(col), r"[^0-9,.]", "")
    brazilian = kept.rlike(r",[^.]*$")
    return F.when(brazilian, F.translate(F.regexp_replace(kept, r"\.", ""), ",", ".")).otherwise(
        F.regexp_replace(kept, ",", "")
    )


def parse_number(col) -> Column:
    """Locale-agnostic text -> DOUBLE; unparsable or blank -> 0.0."""
    return F.coalesce(_try_cast(_number_text(col), "double"), F.lit(0.0))


def parse_money(col) -> Column:
    """Like :func:`parse_number` but exact: DECIMAL(38,6), so sums do not
    depend on the order rows arrive in."""
    return F.coalesce(_try_cast(_number_text(col), MONEY), F.lit(0).cast(MONEY))


def _try_cast(col: Column, type_name: str) -> Column:
    return col.try_cast(type_name)


def safe_div(num, den) -> Column:
    """num / den as DOUBLE, 0.0 when the denominator is 0 or null."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise(n / d)


def round2(col) -> Column:
    """Round to 2 decimals, half-to-even on the binary value times 100.

    ``rint`` is exact IEEE half-even, so Spark and the SQL oracle agree bit
    for bit; Python's ``round(x, 2)`` differs only on products that land
    across a .5 boundary.
    """
    return F.rint(_c(col).cast("double") * 100) / 100


def score_int(col) -> Column:
    """0..1 score -> integer 0..100 (half-to-even, clipped)."""
    return F.least(F.greatest(F.rint(_c(col) * 100).cast("int"), F.lit(0)), F.lit(100))
