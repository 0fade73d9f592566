"""Fixed-point text of numbers, computed with integer arithmetic.

``format_string('%.1f', x)`` rounds differently in Spark (half-up on the
shortest decimal), Python and SQL engines (exact binary); these helpers make
the text a pure function of the already-rounded value, so every engine
produces the same characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cents(x: Column) -> Column:
    """A value already rounded to 2 dp, as an integer number of hundredths."""
    return F.rint(x.cast("double") * 100).cast("long")


def fmt2(x: Column) -> Column:
    """'%.2f' of a 2-dp value."""
    k = _cents(x)
    return F.concat(F.floor(k / 100).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))


def fmt1(x: Column) -> Column:
    """'%.1f' of a 2-dp value, half-to-even on the decimal digit."""
    k = _cents(x)
    q = F.floor(k / 10)
    r = k % 10
    up = (r > 5) | ((r == 5) & (q % 2 == 1))
    t = q + F.when(up, F.lit(1)).otherwise(F.lit(0))
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def fmt0(x: Column) -> Column:
    """'%.0f' (half-to-even on the exact binary value, as Python does)."""
    return F.rint(x.cast("double")).cast("long").cast("string")


_PLACEHOLDER = re.compile(r"\{(\w+)(?::\.(\d)f)?\}")


def template_parts(template: str) -> list[tuple[str, str | None, int | None]]:
    """Split a template into ('lit', text, None) and ('field', name, digits)."""
    parts: list[tuple[str, str | None, int | None]] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(("lit", template[pos:m.start()], None))
        parts.append(("field", m.group(1), None if m.group(2) is None else int(m.group(2))))
        pos = m.end()
    if pos < len(template):
        parts.append(("lit", template[pos:], None))
    return parts


_FORMATTERS = {0: fmt0, 1: fmt1, 2: fmt2}


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill a template from columns (integer / text fields are cast to text)."""
    pieces = []
    for kind, value, digits in template_parts(template):
        if kind == "lit":
            pieces.append(F.lit(value))
        elif digits is None:
            pieces.append(fields[value].cast("string"))
        else:
            pieces.append(_FORMATTERS[digits](fields[value]))
    return F.concat(*pieces)
