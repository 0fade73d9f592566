"""Performance score.

A score is a weighted sum of min-max normalised metrics over a *pool* of
rows.  The pool is either the whole table (global) or the rows sharing some
parent key (siblings).  Pool statistics are computed with an aggregate and
joined back, so no unpartitioned window ever funnels rows into one task:

* global pool -> one-row aggregate, broadcast (its size is 1 row by
  construction) into a nested-loop join that streams the big side;
* sibling pools -> aggregate by parent key, equi-join on that key (AQE
  broadcasts it when small and splits skewed parents otherwise);
* both at once -> the same, with the rows of global pools dealt over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCORE_BAND_FLOOR, SCORE_BANDS, SCORE_WEIGHTS
from ..functions.clean import score_int


def band(score: Column) -> Column:
    out = None
    for lowest, name in SCORE_BANDS:
        out = F.when(score >= lowest, F.lit(name)) if out is None else out.when(score >= lowest, F.lit(name))
    return out.otherwise(F.lit(SCORE_BAND_FLOOR))


def normalised(x: Column, mn: Column, mx: Column, invert: bool) -> Column:
    """Min-max normalise; a constant pool gives 0.5 for every row."""
    norm = (x - mn) / (mx - mn)
    if invert:
        norm = F.lit(1) - norm
    return F.when(mx == mn, F.lit(0.5)).otherwise(norm)


SPREAD = 64


def score(df: DataFrame, pool: list[str] | tuple = (), weights=None, bounded_pool: bool = False, spread: Column | None = None) -> DataFrame:
    """Add ``performance_score`` (int 0-100) and ``score_band``.

    A metric takes part only if its pool sum is positive (all metrics are
    non-negative, so that is ``max > 0``); weights are not re-scaled.
    Terms are added in the order of ``weights`` starting from 0.0.

    ``bounded_pool=True`` declares that the pool keys take a handful of
    values (e.g. the three tree levels), so the statistics are broadcast.
    ``spread`` marks rows of pools that may hold most rows: they are dealt
    over ``SPREAD`` keys, and their statistics repeated as often.
    """
    weights = list(weights or SCORE_WEIGHTS)
    pool = list(pool)
    aggs = []
    for metric, _, _ in weights:
        aggs += [F.min(metric).alias(f"_mn_{metric}"), F.max(metric).alias(f"_mx_{metric}")]
    if pool and spread is not None:
        stats = df.groupBy(*pool).agg(*aggs)
        salts = F.when(spread, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        stats = stats.withColumn("_mn_salt", F.explode(salts))
        salt = F.when(spread, F.pmod(F.xxhash64(*[c for c in df.columns if c not in pool]), F.lit(SPREAD)).cast("int")).otherwise(0)
        joined = df.withColumn("_mn_salt", salt).join(stats, [*pool, "_mn_salt"], "left")
    elif pool:
        stats = df.groupBy(*pool).agg(*aggs)
        joined = df.join(F.broadcast(stats) if bounded_pool else stats, pool, "left")
    else:
        stats = df.agg(*aggs)
        joined = df.crossJoin(F.broadcast(stats))
    total: Column = F.lit(0.0)
    for metric, weight, invert in weights:
        mn, mx = F.col(f"_mn_{metric}"), F.col(f"_mx_{metric}")
        term = normalised(F.col(metric), mn, mx, invert) * F.lit(float(weight))
        total = total + F.when(mx > 0, term).otherwise(F.lit(0.0))
    s = score_int(total)
    out = joined.withColumn("performance_score", s).withColumn("score_band", band(F.col("performance_score")))
    return out.drop(*[c for c in out.columns if c.startswith("_mn_") or c.startswith("_mx_")])
