"""Mixing sources to target weights by balanced sampling (the cube method).

Each source gets a share of all words by its weight, at most three times its
own. A document of a source is taken floor(e) or floor(e) + 1 times, where e =
target / source size. Which of the two is drawn so that, in each source, both
the number of documents and the number of words stay as expected: inclusion
probabilities move within the null-space of these two constraints until each
is 0 or 1 (flight); at most two per source are left, and these are settled by
trying their few outcomes (landing).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adfunnel.llm._store import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
_EPS = 1e-9


def n_words(text: F.Column) -> F.Column:
    """Number of words of a text, null: 0."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("bigint")


def targets(sizes: list[tuple], weights: tuple = WEIGHTS, most: int = MOST) -> list[tuple]:
    """(source, size, target) for (source, size) rows in weight order.

    The total is shared by weight; a target above ``most`` times its source's
    size stops there, and the rest is shared again by weight among the others
    until none is above. All sources at their stop (or of size 0): the rest is
    left. Integer sums and exact fractions keep reruns equal.
    """
    from fractions import Fraction

    total = Fraction(sum(n for _, n in sizes))
    stopped: dict[int, Fraction] = {}
    share: dict[int, Fraction] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        left = total - sum(stopped.values())
        whole = sum(weights[i % len(weights)] for i in free)
        share = {i: left * weights[i % len(weights)] / whole for i in free} if free else {}
        over = [i for i in free if share[i] > most * sizes[i][1]]
        if not over:
            break
        stopped |= {i: Fraction(most * sizes[i][1]) for i in over}
    return [(s, n, float(stopped.get(i, share.get(i, Fraction(0))))) for i, (s, n) in enumerate(sizes)]


def flight(p: np.ndarray, x: np.ndarray, u: Iterator[float]) -> np.ndarray:
    """Move probabilities to 0 or 1 keeping sum(p) and sum(p * x); up to two stay between.

    Three open units at a time: (x2 - x3, x3 - x1, x1 - x2) is orthogonal to
    both constraints; a step along it, to either side with the chance that
    keeps expectations, settles one unit, whose place the next one takes.
    """
    p = p.astype(float).copy()
    hand: list[int] = []
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            hand.append(i)
        else:
            p[i] = round(p[i])
        if len(hand) < 3:
            continue
        a, b, c = hand
        d = [x[b] - x[c], x[c] - x[a], x[a] - x[b]]
        if d[0] == d[1] == d[2] == 0:
            d = [1.0, -1.0, 0.0]
        up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(hand, d, strict=True) if v)
        down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(hand, d, strict=True) if v)
        step = up if next(u) * (up + down) < down else -down
        keep = []
        for k, v in zip(hand, d, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * v))
            if _EPS < p[k] < 1 - _EPS:
                keep.append(k)
            else:
                p[k] = round(p[k])
        hand = keep
    return p


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Settle the few open units: the outcome nearest to the expected words, then to the expected count."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    if open_:
        want, count = sum(p[i] * x[i] for i in open_), sum(p[i] for i in open_)
        best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda s: (abs(sum(a * x[i] for a, i in zip(s, open_, strict=True)) - want), abs(sum(s) - count), s))
        p[open_] = best
    return p


def _uniform(seed: int) -> Iterator[float]:
    rng = np.random.default_rng(seed)
    while True:
        yield from rng.random(1024).tolist()


def _pieces(own: DataFrame, block_rows: int) -> DataFrame:
    """``own`` with equal rows as one row with their number m; of many, as several of a part of a block each, dealt apart by an ``h`` of their own."""
    most = max(1, block_rows // 20)
    each = own.groupBy(*own.columns).agg(F.count("*").alias("c"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / most).cast("int"))).alias("k"))
    h = F.when(F.col("k") == 0, F.col("h")).otherwise(F.xxhash64("h", "k"))
    return each.select("id", "source", "size", h.alias("h"), F.col("h").alias("key"), F.least(F.lit(most), F.col("c") - F.col("k") * most).cast("bigint").alias("m"))


def _block(level: int, blocks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(level), "h"), F.greatest(blocks, F.lit(1)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, seed: int = 17, block_rows: int = 20_000, words: F.Column | None = None, keyed: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with size, source_size, target, copies and taken, per row.

    A source with a third of all rows is dealt into blocks of about
    ``block_rows`` rows; the flight runs in each block, what is left open (two
    rows a block) is dealt into blocks again, and the last block of a source
    lands. Null texts have size 0 and are taken 0 words; a null source is a
    source of its own, last in order; null and repeated ids are rows like any
    other. Equal rows take each other's place: they are counted, and the counts
    are dealt into blocks in parts. Results depend on the rows, not on their
    place. An empty table gives an empty result. With ``keyed``, ``key`` is the
    hash of seed, id and text by which ``repeat_rows`` finds the row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = n_words(F.col(text_col)) if words is None else words
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    base = scratch.save(_pieces(own, block_rows), "sizes")
    stats = base.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("n"), F.sum("m").alias("rows"))
    # one row per source; the order is by code point, as Python compares strings
    got = sorted(stats.collect(), key=lambda r: (r.source is None, r.source or ""))
    rows = [(s, n, t, r.rows) for (s, n, t), r in zip(targets([(r.source, int(r.n)) for r in got], weights, most), got, strict=True)]
    plan = spark.createDataFrame(rows, f"source {docs.schema[source_col].dataType.simpleString()}, source_size bigint, target double, source_rows bigint")
    # broadcast: one row per source
    joined = base.join(F.broadcast(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate).withColumn("floor", F.floor("rate")).withColumn("p", F.col("rate") - F.col("floor"))

    def settle(last: bool):
        def run(key, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.loc[frame.index.repeat(frame.m)].assign(m=1)
            frame = frame.sort_values(["h", "id", "size"], kind="stable", ignore_index=True)
            draws = _uniform(abs(hash((seed, int(frame.h.iloc[0]), len(frame)))))
            p = flight(frame.p.to_numpy(), frame["size"].to_numpy(float), draws)
            frame["p"] = landing(p, frame["size"].to_numpy(float)) if last else p
            return frame

        return run

    cols = joined.columns
    schema = joined.schema.simpleString()[7:-1].replace(":", " ")
    level, open_, done = 0, joined, []
    most_rows = max([r.rows for r in got], default=0)
    while True:
        blocks = F.ceil(F.col("source_rows") / F.lit(float(block_rows * (block_rows // 4) ** level))).cast("int")
        last = most_rows <= block_rows * (block_rows // 4) ** level
        out = open_.withColumn("block", _block(level, blocks)).groupBy("source", "block")
        out = scratch.save(out.applyInPandas(_typed(settle(last), cols), schema), f"level{level}")
        done.append(out.where("p <= 0 or p >= 1"))
        if last:
            break
        open_, level = out.where("p > 0 and p < 1"), level + 1
    whole = reduce(DataFrame.unionByName, done)
    whole = whole.withColumn("copies", (F.col("floor") + F.col("p")).cast("bigint"))
    out = whole.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")
    return out if keyed else out.drop("key")


def _typed(run, cols):
    return lambda key, frame: run(key, frame[cols])


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; ``mixed`` is ``mix(docs, keyed=True)`` with the same seed.

    Rows are found by id, text and source, so rows that share an id have counts
    of their own. Rows equal in all three take each other's place: their copies
    are dealt to them evenly, those left over to some of them. Null ids, texts
    and sources are values like any other; columns keep their names whatever
    they are. An empty table gives an empty result.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    col = dict(zip(docs.columns, map(F.col, plain), strict=True))
    taken = mixed.groupBy(F.col("key").alias("t_key"), F.col(source_col).alias("t_source")).agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).where(F.col("all") > 0)
    key = F.xxhash64(F.lit(seed), col[id_col], col[text_col])
    rows = docs.toDF(*plain).withColumn("key", key)
    out = rows.join(taken, (F.col("key") == F.col("t_key")) & col[source_col].eqNullSafe(F.col("t_source")))
    # numbers of equal rows; the join has dealt by the same key
    number = F.when(F.col("rows") == 1, 1).otherwise(F.row_number().over(Window.partitionBy("key", "t_source").orderBy("key")))
    copies = F.floor(F.col("all") / F.col("rows")) + F.when(number <= F.col("all") % F.col("rows"), 1).otherwise(0)
    out = out.select(*plain, copies.cast("int").alias("copies")).where("copies > 0")
    return out.select(*plain, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one")).select(*plain).toDF(*docs.columns)
