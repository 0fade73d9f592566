"""Line dedup over a suffix array of line ids (DataFrame functions only).

The lines of a document with a word are a sequence of ids (128-bit hashes of
the exact line); all sequences together have one suffix array.

* Prefix doubling: a suffix's rank by its first 2k lines is the rank of the
  pair (rank by the first k, rank of the suffix k lines on by its first k).
  Suffixes alone at their rank share nothing deeper and are sorted no further,
  so work follows the repeated lines only. Doubling ends where no rank is
  shared; the ranks of every depth are stored.
* LCP intervals: suffixes that share their first 2^k lines but not twice as
  many are split by the ranks of the 2^(k-1), 2^(k-2), ... lines that follow.
  Of those that go on alike the first (by document, then place) stays behind
  for them, and they go one level down. What is left together in the end is an
  interval of the array: its longest common prefix, and the first suffix of
  each of its children.
* Maximal runs: a suffix belongs to one interval that it doesn't come first in,
  the deepest, whose prefix is its longest copy of anything earlier. A run that
  doesn't lie inside the run one line before it is maximal.

The lines in a maximal run are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adfunnel.llm._store import Scratch

_SPACE = " \t\n\x0b\x0c\r"
MIN_LINES = 2
#: A group with more than this part of all rows is joined by broadcast; there are fewer than 1 / HOT of them.
HOT = 0.001
_PLACE = ("id", "t", "j")


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _place() -> Column:
    return F.struct(*_PLACE)


def _sequence(docs: DataFrame) -> DataFrame:
    """(id, t, j, line): the j-th line with a word of each document and its line id; t tells texts of an equal id apart."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    # repeated rows are one document, made so before anything is dealt by document
    return docs.select("id", "t", F.posexplode(F.transform(lines, _digest)).alias("j", "line")).distinct()


def _groups(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Values of ``keys`` that two rows or more share, with their number n, their first place g_first and a rank g in the order of the keys."""
    shared = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(_place()).alias("g_first")).where("n > 1")
    # sorted over all partitions, the increasing id keeps the order without numbering in one task
    return scratch.save(shared.orderBy(*keys).select("*", F.monotonically_increasing_id().alias("g")), name)


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` with g and g_first of their group; rows of large groups aren't dealt by key."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") > total * HOT).drop("n")
    rest = groups.where(F.col("n") <= total * HOT).drop("n")
    # broadcast: fewer than 1 / HOT rows, as their numbers add up to the total
    many = rows.join(F.broadcast(hot), keys)
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return many.unionByName(few)


def _doubled(docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Per depth 2^k the suffixes that share their first 2^k lines: place, rank, first of the rank; and g, g_first, the same for twice the depth, null where nothing is shared."""
    seq = scratch.save(_sequence(docs), "lines")
    tied = _with_groups(seq, _groups(seq, ["line"], scratch, "ranks0"), ["line"], "inner")
    levels: list[DataFrame] = []
    while True:
        k = len(levels)
        tied = tied.select(*_PLACE, F.col("g").alias("rank"), F.col("g_first").alias("first"))
        ahead = Window.partitionBy("id", "t").orderBy("j").rangeBetween(1 << k, 1 << k)
        pairs = scratch.save(tied.withColumn("next", F.max("rank").over(ahead)), f"pairs{k}")
        whole, short = pairs.where("next is not null"), pairs.where("next is null")
        groups = _groups(whole, ["rank", "next"], scratch, f"ranks{k + 1}")
        short = short.withColumn("g", F.lit(None).cast("bigint")).withColumn("g_first", F.lit(None).cast(groups.schema["g_first"].dataType))
        out = _with_groups(whole, groups, ["rank", "next"], "left").unionByName(short)
        levels.append(scratch.save(out.drop("next"), f"depth{k}"))
        scratch.drop(f"pairs{k}")
        if groups.isEmpty():
            return levels
        tied = levels[k].where("g is not null")


def _split(sets: DataFrame, ranks: DataFrame, b: int, scratch: Scratch) -> DataFrame:
    """Sets (place, depth, first) split by the rank of the 2^b lines after their depth; what goes on alike is a set 2^b deeper."""
    ranks = ranks.select(F.col("id").alias("r_id"), F.col("t").alias("r_t"), F.col("j").alias("r_j"), F.col("rank").alias("after"))
    here = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("t") == F.col("r_t")) & (F.col("j") + F.col("depth") == F.col("r_j"))
    sets = scratch.save(sets.join(ranks, here, "left").drop("r_id", "r_t", "r_j"), f"after{b}")
    keys = ["depth", "first", "after"]
    on, alone = sets.where("after is not null"), sets.where("after is null")
    on = _with_groups(on, _groups(on, keys, scratch, f"split{b}"), keys, "left")
    deeper = on.where("g is not null").select(*_PLACE, (F.col("depth") + (1 << b)).alias("depth"), F.col("g_first").alias("first"))
    stay = on.where(F.col("g").isNull() | (F.col("g_first") == _place())).select(*_PLACE, "depth", "first")
    out = scratch.save(deeper.unionByName(stay).unionByName(alone.select(*_PLACE, "depth", "first")), f"sets{b}")
    scratch.drop(f"after{b}", f"split{b}")
    return out


def longest_copies(docs: DataFrame, scratch: Scratch, min_lines: int) -> DataFrame:
    """(id, t, j, n_lines, first): per line the longest run from it on, of ``min_lines`` or more lines, that also starts earlier, and the first place where it does."""
    levels = _doubled(docs, scratch)
    # of suffixes that share twice the depth the first stands for all: against others they share the same
    heads = [
        level.where(F.col("g").isNull() | (F.col("g_first") == _place())).select(*_PLACE, F.lit(1 << k).alias("depth"), "first")
        for k, level in enumerate(levels)
    ]
    low = [k for k in range(len(levels)) if 2 << k > min_lines]  # below them nothing reaches min_lines
    if not low:
        return heads[0].select(*_PLACE, F.col("depth").alias("n_lines"), "first").where("false")
    sets = heads[-1]
    for b in range(len(levels) - 2, -1, -1):
        sets = _split(sets, levels[b], b, scratch)
        if b in low:
            sets = sets.unionByName(heads[b])
    return sets.where((_place() != F.col("first")) & (F.col("depth") >= min_lines)).select(*_PLACE, F.col("depth").alias("n_lines"), "first")


def repeated_runs(docs: DataFrame, scratch: Scratch, min_lines: int) -> DataFrame:
    """(id, t, j, n_lines, first): maximal runs of ``min_lines`` or more lines that also start earlier, and the first place where they do; ``docs`` has id, t, text.

    Maximal: no line more on either side is copied from earlier with them. A
    run may overlap its earlier copy, and other runs.
    """
    longest = longest_copies(docs, scratch, min_lines)
    before = F.max("n_lines").over(Window.partitionBy("id", "t").orderBy("j").rangeBetween(-1, -1))
    return longest.withColumn("before", before).where("before is null or before <= n_lines").drop("before")


def _spans(runs: DataFrame) -> DataFrame:
    """(id, t, spans): the lines of a document's runs as stretches (start, stop) that don't overlap; at most the lines of one document."""
    done = F.max(F.col("j") + F.col("n_lines")).over(Window.partitionBy("id", "t").orderBy("j").rowsBetween(Window.unboundedPreceding, -1))
    start, stop = F.greatest("j", done).alias("start"), (F.col("j") + F.col("n_lines")).alias("stop")
    return runs.select("id", "t", start, stop).where("start < stop").groupBy("id", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, counts: bool = True) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and n_lines, n_removed (long).

    A run is ``min_lines`` or more consecutive lines (the rows of
    ``repeated_runs`` are the maximal ones); lines without a word are
    neither counted nor deleted. Earlier means a smaller id (null first), or an
    earlier place in the same text. Rows that share id and text are one
    document and stay equal. A null text stays null with 0 lines; an empty
    text stays empty; a text whose lines all go becomes empty and its row
    stays. An empty table gives an empty result. Other columns are kept, also
    where they are called like columns used here; only n_lines and n_removed
    take the place of columns of their names, and without ``counts`` they are
    not made.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    gone = _spans(repeated_runs(own, scratch, min_lines)).withColumnsRenamed({"id": "g_id", "t": "g_t"})
    # every column goes through the join once, under a name that can't clash
    plain = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, plain, strict=True))
    i, text = F.col(names[id_col]), F.col(names[text_col])
    out = docs.toDF(*plain).join(gone, i.eqNullSafe(F.col("g_id")) & (_digest(text) == F.col("g_t")), "left")
    out = out.withColumn("gone", F.expr("flatten(transform(spans, s -> sequence(s.start, s.stop - 1)))"))
    out = out.select(*plain, "gone", F.split(text, "\n").alias("lines"))
    # places of lines with a word; the sequence counts only these
    at = F.transform("lines", lambda x, i: F.when(F.length(F.btrim(x, F.lit(_SPACE))) > 0, i).otherwise(-1))
    out = out.withColumn("at", F.filter(at, lambda i: i >= 0))
    out = out.withColumn("rest", F.when(F.col("gone").isNotNull(), F.expr("array_except(sequence(0, size(lines) - 1), transform(gone, j -> at[j]))")))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.expr("transform(rest, i -> lines[i])"), "\n"))
    made = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size("at")).cast("bigint"), "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint")} if counts else {}
    kept = [(left if c == text_col else F.col(names[c])).alias(c) for c in docs.columns if c not in made]
    return out.select(*kept, *(x.alias(c) for c, x in made.items()))
