"""Prefix trie of conversations, built as a z-fast trie.

A conversation is a string of turns. Each of its prefixes has a 128-bit name,
computed from sums of hashes of (place, turn), so prefixes of a conversation of
any length are named without gathering it in one row or task.

The compacted trie is a table of nodes. A node stands for the edge from depth
``up`` to depth ``len`` of a conversation ``rep``. Its handle is the prefix at
the depth in (up, len] that the largest power of two divides (the two-fattest),
and the table is a dictionary by handle. The node where a conversation leaves
the trie is located by fat binary search: probes at two-fattest depths, whose
number grows with the logarithm of the depth, each a join with the dictionary.
The child below the deepest node passed, and the last common depth with its
edge, complete the exit point.

Conversations go in in batches: of all that leave the trie at one point with
the same next turn one is drawn, and those drawn split edges and add leaves
together. The others are located again from there on. Draws are hashed, so the
number of batches grows with the logarithm of the number of conversations that
share a prefix, not with their depth.

Sums over subtrees take as many rounds as the logarithm of the depth (each
round doubles the distance that a node's sums have come up). At the end edges
are expanded to one row per depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adfunnel.llm._store import Scratch

IDS_A_ROW = 4096
_FATTEST = "{b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1)"


def _ranged(rows: DataFrame, cols: list, scratch: Scratch, name: str) -> DataFrame:
    """``cols`` of rows with ``at``, a number by conversation, turn (null first), role and text, and ``part``, the task that gave it.

    Rows are dealt by ranges, so a conversation of any length is spread.
    """
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role")]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    at = F.monotonically_increasing_id()
    return scratch.save(dealt.select("conv_id", *cols, at.alias("at"), F.shiftright(at, 33).alias("part")), name)


def _before(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Per (conv_id, part) the sums of the conversation's earlier parts."""
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv_id", "part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias("before_" + c) for c in sums))


def _placed(ranged: DataFrame) -> DataFrame:
    """Rows with ``place``: their number in the conversation, from 0."""
    parts = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    first = parts.select("conv_id", "part", "first").join(_before(parts, ["n"]), ["conv_id", "part"])
    return ranged.join(first, ["conv_id", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before_n")).drop("first", "before_n", "at")


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, place): turns with their place in the conversation, from 0, by turn (null first), role and text."""
    return _placed(_ranged(turns, ["role", "text"], Scratch(turns.sparkSession, "turns"), "ranged")).drop("part")


def _prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, d, f, g, bytes): name of the prefix of d turns, and the UTF-8 bytes of its texts."""
    x = [F.xxhash64(F.lit(k), "role", "text").alias(f"x{k}") for k in (1, 2)]
    ranged = _ranged(turns, [*x, F.octet_length("text").cast("bigint").alias("bytes")], scratch, "ranged")
    placed = _placed(ranged).withColumn("d", F.col("place") + 1)
    half = lambda h: (h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32))
    terms = [t for k in (1, 2) for t in half(F.xxhash64(F.lit(k), "d", "x1", "x2"))]
    sums = ["s0", "s1", "s2", "s3", "bytes"]
    w = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("conv_id", "part", "d", "bytes", *(t.alias(f"s{k}") for k, t in enumerate(terms)))
    placed = scratch.save(placed.select("conv_id", "part", "d", *(F.sum(c).over(w).alias(c) for c in sums)), "placed")
    parts = placed.groupBy("conv_id", "part").agg(*(F.max(c).alias(c) for c in sums))  # sums only grow
    own = placed.join(_before(parts, sums), ["conv_id", "part"]).select("conv_id", "d", *((F.col(c) + F.col("before_" + c)).alias(c) for c in sums))
    name = [F.xxhash64(F.lit(k), "d", "s0", "s1", "s2", "s3").alias(n) for k, n in ((1, "f"), (2, "g"))]
    return own.select("conv_id", "d", *name, "bytes")


def _at(own: DataFrame, state: DataFrame, i: str, d, f: str, g: str) -> DataFrame:
    """``state`` with the name (f, g) of the prefix of conversation ``i`` at depth ``d``, null beyond its end."""
    names = own.select(F.col("id").alias("at_id"), F.col("d").alias("at_d"), F.col("f").alias(f), F.col("g").alias(g))
    return state.join(names, (F.col(i) == F.col("at_id")) & (d == F.col("at_d")), "left").drop("at_id", "at_d")


def _spread(c: str):
    """A name to join by; where it is missing a number that stands for no name, other for each row."""
    return F.coalesce(F.col(c), F.col("id"))


def locate(nodes: DataFrame, own: DataFrame, strings: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, n, e, rep, len, up): where each string (id, n, a) leaves the trie, e turns deep.

    ``a`` is the depth of a node that the string is known to pass. With a null
    rep it leaves at a node, or ends there; else on the edge of the node (rep,
    len) that begins at ``up``.
    """
    s = strings.select("id", "n", "a", F.col("n").alias("b"), *(F.lit(None).cast("bigint").alias(c) for c in ("lo", "rep", "len", "up")))
    to = nodes.select("hf", "hg", "hd", F.col("f").alias("nf"), F.col("g").alias("ng"), F.col("rep").alias("t_rep"), F.col("len").alias("t_len"), F.col("up").alias("t_up"))
    active = F.col("lo").isNull() & F.expr("a < b")
    k = 0
    while k == 0 or s.where(active).limit(1).count():  # a probe more than n - a has binary digits at most
        s = s.withColumn("probe", F.when(active, F.expr(_FATTEST.format(a="a", b="b"))).otherwise(-1))
        s = _at(own, s, "id", F.col("probe"), "pf", "pg")
        s = s.join(to, (_spread("pf") == F.col("hf")) & (F.col("pg") == F.col("hg")) & (F.col("probe") == F.col("hd")), "left")
        s = _at(own, s, "id", F.coalesce("t_len", F.lit(-1)), "ef", "eg")
        passed = F.coalesce((F.col("ef") == F.col("nf")) & (F.col("eg") == F.col("ng")), F.lit(False))
        left = F.col("t_len").isNotNull() & ~passed
        s = s.select(
            "id", "n", F.when(passed, F.col("t_len")).otherwise(F.col("a")).alias("a"),
            F.when((F.col("probe") > 0) & F.col("t_len").isNull(), F.col("probe") - 1).otherwise(F.col("b")).alias("b"),
            F.when(left, F.col("probe")).otherwise(F.col("lo")).alias("lo"),
            *(F.when(left, F.col("t_" + c)).otherwise(F.col(c)).alias(c) for c in ("rep", "len", "up")),
        )
        s = scratch.save(s, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        k += 1
    # the child by the next turn: its edge may be left before its handle
    s = _at(own, s, "id", F.when(F.col("lo").isNull(), F.col("a") + 1).otherwise(-1), "pf", "pg")
    child = nodes.select("cf", "cg", F.col("rep").alias("t_rep"), F.col("len").alias("t_len"), F.col("up").alias("t_up"))
    s = s.join(child, (_spread("pf") == F.col("cf")) & (F.col("pg") == F.col("cg")), "left")
    s = s.select("id", "n", "a", F.when(F.col("t_len").isNotNull(), F.col("a") + 1).otherwise(F.col("lo")).alias("lo"), *(F.coalesce("t_" + c, c).alias(c) for c in ("rep", "len", "up")))
    # the last depth at which the string and the edge agree
    mine = own.select(F.col("id").alias("m_id"), F.col("d").alias("m_d"), F.col("f").alias("m_f"), F.col("g").alias("m_g"))
    edge = own.select(F.col("id").alias("e_id"), F.col("d").alias("e_d"), F.col("f").alias("e_f"), F.col("g").alias("e_g"))
    on = s.where("rep is not null").select("id", "lo", F.least("n", "len").alias("hi"), "rep")
    same = on.join(mine, (F.col("id") == F.col("m_id")) & (F.col("m_d") > F.col("lo")) & (F.col("m_d") <= F.col("hi")))
    same = same.join(edge, (F.col("rep") == F.col("e_id")) & (F.col("m_d") == F.col("e_d")) & (F.col("m_f") == F.col("e_f")) & (F.col("m_g") == F.col("e_g")))
    deep = same.groupBy("id").agg(F.max("m_d").alias("deep"))
    return s.join(deep, "id", "left").select("id", "n", F.coalesce("deep", "lo", "a").alias("e"), "rep", "len", "up")


def _named(fresh: DataFrame, own: DataFrame) -> DataFrame:
    """Nodes (rep, up, len) with their names, handles and first turns' names."""
    fresh = fresh.withColumn("hd", F.expr(_FATTEST.format(a="up", b="len")))
    of = own.select(F.col("id").alias("o_id"), "d", "f", "g", "bytes")
    met = fresh.join(of, (F.col("rep") == F.col("o_id")) & ((F.col("d") == F.col("len")) | (F.col("d") == F.col("hd")) | (F.col("d") == F.col("up") + 1) | (F.col("d") == F.col("up"))))
    pick = lambda c, d, name: F.max(F.when(F.col("d") == F.col(d) if isinstance(d, str) else F.col("d") == d, F.col(c))).alias(name)
    first = F.col("up") + 1
    return met.groupBy("rep", "up", "len", "hd").agg(pick("f", "len", "f"), pick("g", "len", "g"), pick("f", "hd", "hf"), pick("g", "hd", "hg"), pick("f", first, "cf"), pick("g", first, "cg"), pick("f", "up", "pf"), pick("g", "up", "pg"), pick("bytes", "len", "bytes"), pick("bytes", "up", "up_bytes"))


def insert(nodes: DataFrame | None, own: DataFrame, strings: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie with all ``strings`` (id, n) in it; ``nodes`` is the trie so far, if any.

    ``own`` has the names of all prefixes, from depth 0 on, of the strings and
    of those in the trie. Every string has a turn, and no two are equal.
    """
    left, k = strings.select("id", "n", F.lit(0).cast("bigint").alias("a")), 0
    while True:
        left = scratch.save(left, f"left{k}")
        if not left.limit(1).count():
            return nodes if nodes is not None else _named(left.select(F.col("id").alias("rep"), F.col("a").alias("up"), F.col("n").alias("len")), own)
        if nodes is None:
            none = F.lit(None).cast("bigint")
            exits = left.select("id", "n", F.col("a").alias("e"), none.alias("rep"), none.alias("len"), none.alias("up"))
        else:
            exits = locate(nodes, own, left, scratch, f"probe{k}")
        exits = _at(own, exits.where("rep is not null or e < n"), "id", F.least(F.col("e") + 1, F.col("n")), "kf", "kg")
        exits = scratch.save(exits, f"exits{k}")
        # one of those that go on with the same turn; a string that ends on an edge is alone
        drawn = exits.groupBy("kf", "kg", (F.col("e") < F.col("n")).alias("on")).agg(F.min(F.struct(F.xxhash64("id").alias("x"), F.col("id"))).alias("m")).select(F.col("m.id").alias("id"))
        drawn = scratch.save(exits.join(drawn, "id"), f"drawn{k}")
        split = drawn.where("rep is not null and e < len").select("rep", "len", "up", F.col("e").alias("to")).distinct()
        whole = split.select("rep", "len").distinct()
        chain = split.unionByName(split.select("rep", "len", "up", F.col("len").alias("to")).distinct())
        above = F.lag("to").over(Window.partitionBy("rep", "len").orderBy("to"))
        chain = chain.select("rep", F.coalesce(above, "up").alias("up"), F.col("to").alias("len"))
        leaves = drawn.where("n > e").select(F.col("id").alias("rep"), F.col("e").alias("up"), F.col("n").alias("len"))
        fresh = _named(chain.unionByName(leaves), own)
        grown = fresh if nodes is None else nodes.join(whole, ["rep", "len"], "left_anti").unionByName(fresh)
        nodes = scratch.save(grown, f"nodes{k}")
        left = exits.join(drawn.select("id"), "id", "left_anti").select("id", "n", F.col("e").alias("a"))
        scratch.drop(f"nodes{k - 1}", f"left{k}")
        k += 1


def _subtrees(nodes: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """``nodes`` with ``sums``, and the least ``least``, over their subtrees; ``pf``, ``pg`` name the parent, a null the root."""
    aggs = [*(F.sum(c).alias("a_" + c) for c in sums), F.min("least").alias("a_least")]
    cur, k = nodes.withColumn("jf", F.col("pf")).withColumn("jg", F.col("pg")), 0
    while True:
        cur = scratch.save(cur, f"sums{k}")
        if not cur.where("jf is not null").limit(1).count():
            return cur.drop("jf", "jg")
        up = cur.where("jf is not null")
        come = up.groupBy(F.col("jf").alias("f"), F.col("jg").alias("g")).agg(*aggs)
        further = cur.select(F.col("f").alias("tf"), F.col("g").alias("tg"), F.col("jf").alias("nf"), F.col("jg").alias("ng"))
        jump = up.join(further, (F.col("jf") == F.col("tf")) & (F.col("jg") == F.col("tg"))).select("f", "g", F.col("nf").alias("jf"), F.col("ng").alias("jg"))
        cur = cur.drop("jf", "jg").join(come, ["f", "g"], "left").join(jump, ["f", "g"], "left")
        cur = cur.withColumns({c: F.col(c) + F.coalesce("a_" + c, F.lit(0)) for c in sums} | {"least": F.least("least", "a_least")}).drop(*("a_" + c for c in sums), "a_least")
        scratch.drop(f"sums{k - 1}")
        k += 1


def _digests(ends: DataFrame) -> DataFrame:
    """(f, g, sha) of the ascending ids (f, g, conv_id), comma-joined.

    Ids are gathered in rows of at most ``IDS_A_ROW`` by tasks over ranges; a
    digest then reads its rows one after the other, so no list is held whole.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows = None, [], []

        def flush():
            if ids:
                rows.append((*at, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for f, g, i in zip(*(batch.column(c).to_pylist() for c in ("f", "g", "conv_id")), strict=True):
                if (f, g) != at or len(ids) == IDS_A_ROW:
                    flush()
                    at = f, g
                ids.append(i)
            yield table(rows, ["f", "g", "first", "ids"], [pa.int64()] * 3 + [pa.string()])
            rows.clear()
        flush()
        yield table(rows, ["f", "g", "first", "ids"], [pa.int64()] * 3 + [pa.string()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, rows = None, None, []
        for batch in batches:
            for f, g, ids in zip(*(batch.column(c).to_pylist() for c in ("f", "g", "ids")), strict=True):
                if (f, g) != at:
                    if at:
                        rows.append((*at, sha.hexdigest()))
                    at, sha = (f, g), hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield table(rows, ["f", "g", "sha"], [pa.int64()] * 2 + [pa.string()])
            rows.clear()
        if at:
            yield table([(*at, sha.hexdigest())], ["f", "g", "sha"], [pa.int64()] * 2 + [pa.string()])

    def table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    parts = ends.repartitionByRange("f", "g", "conv_id").sortWithinPartitions("f", "g", "conv_id").mapInArrow(gather, "f bigint, g bigint, first bigint, ids string")
    return parts.repartition("f", "g").sortWithinPartitions("f", "g", "first").mapInArrow(digest, "f bigint, g bigint, sha string")


def conversation_nodes(turns: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns`` (conv_id, turn, role, text), from the empty one at depth 0 on.

    Columns: conv_id, the smallest member; depth; parent_conv_id; n_convs, the
    conversations that begin with it; n_children; n_leaves, childless nodes of
    its subtree; saved_tokens, over its subtree the UTF-8 bytes of each node's
    last text times its members less one; ends_sha256, the digest of the
    ascending ids of the conversations that end here, comma-joined.

    ``conv_ids`` may name further conversations, without turns, which end at the
    root. Turns go by ``turn`` (null first), ties by role, then text; a repeated
    row is a turn of its own. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation and are left out. Other columns are not
    read. Without conversations the result is empty.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    zero = F.lit(0).cast("bigint")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    prefixes = scratch.save(_prefixes(rows, scratch), "prefixes")
    last = prefixes.groupBy("conv_id").agg(F.max("d").alias("n"))
    ends = prefixes.join(last, "conv_id").where("d = n").select("conv_id", "n", "f", "g", "bytes")
    if conv_ids is not None:
        bare = conv_ids.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().join(last, "conv_id", "left_anti")
        ends = ends.unionByName(bare.select("conv_id", *(zero.alias(c) for c in ("n", "f", "g", "bytes"))))
    ends = scratch.save(ends, "ends")
    strings = scratch.save(ends.groupBy("f", "g", "n", "bytes").agg(F.min("conv_id").alias("id"), F.count("*").alias("convs")), "strings")
    some = strings.where("n > 0")
    own = prefixes.join(some.select(F.col("id").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("id"), "d", "f", "g", "bytes")
    own = scratch.save(own.unionByName(some.select("id", *(zero.alias(c) for c in ("d", "f", "g", "bytes")))), "own")
    nodes = insert(None, own, some.select("id", "n"), scratch)

    end = some.select("f", "g", F.col("id").alias("least"), "convs", (F.col("convs") * F.col("bytes")).alias("read"))
    parents = nodes.where("up > 0").groupBy(F.col("pf").alias("f"), F.col("pg").alias("g")).agg(F.count("*").alias("children"))
    tops = F.col("up") == 0
    full = nodes.select("rep", "up", "len", "f", "g", F.when(~tops, F.col("pf")).alias("pf"), F.when(~tops, F.col("pg")).alias("pg"), "bytes", "up_bytes").join(end, ["f", "g"], "left").join(parents, ["f", "g"], "left")
    full = full.withColumns({"convs": F.coalesce("convs", zero), "read": F.coalesce("read", zero), "children": F.coalesce("children", zero), "edge": F.col("bytes") - F.col("up_bytes")})
    full = _subtrees(full.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint")), ["convs", "read", "edge", "leaves"], scratch)
    # bytes of all members from this edge on, less those of each edge once
    full = full.withColumn("saved", F.col("read") - F.col("convs") * F.col("up_bytes") - F.col("edge"))
    tops = full.where("pf is null").select(F.col("least").alias("conv_id"), "convs", F.lit(1).cast("bigint").alias("children"), "leaves", "saved")
    tops = tops.unionByName(strings.where("n = 0").select(F.col("id").alias("conv_id"), "convs", zero.alias("children"), zero.alias("leaves"), zero.alias("saved")))
    root = tops.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("convs", "children", "leaves", "saved"))).where("conv_id is not null")
    root = root.select("conv_id", zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.col("children").alias("n_children"), F.greatest("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.col("saved").alias("saved_tokens"), zero.alias("f"), zero.alias("g"))
    root = scratch.save(root, "root")
    first = root.select("conv_id").first()  # one row at most

    above = full.select(F.col("f").alias("a_f"), F.col("g").alias("a_g"), F.col("least").alias("above"))
    full = full.join(above, (F.coalesce("pf", "rep") == F.col("a_f")) & (F.col("pg") == F.col("a_g")), "left")
    of = own.select(F.col("id").alias("o_id"), "d", F.col("f").alias("d_f"), F.col("g").alias("d_g"), F.col("bytes").alias("d_bytes"))
    each = full.join(of, (F.col("rep") == F.col("o_id")) & (F.col("d") >= F.col("up")) & (F.col("d") < F.col("len")))
    # from each depth on an edge the next one down, with the bytes above it
    low = F.col("d") + 1 == F.col("len")
    each = each.select(
        F.col("least").alias("conv_id"), (F.col("d") + 1).alias("depth"),
        F.when(F.col("d") > F.col("up"), F.col("least")).otherwise(F.coalesce(F.col("above"), F.lit(first[0] if first else None))).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(low, F.col("children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("convs") - 1) * (F.col("d_bytes") - F.col("up_bytes"))).alias("saved_tokens"),
        F.when(low, F.col("f")).otherwise(F.lit(None)).alias("f"), F.when(low, F.col("g")).otherwise(F.lit(None)).alias("g"),
    )
    sha = _digests(ends.select("f", "g", "conv_id"))
    sha = sha.select(F.col("f").alias("s_f"), F.col("g").alias("s_g"), "sha")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = each.unionByName(root).join(sha, (F.coalesce("f", "conv_id") == F.col("s_f")) & (F.col("g") == F.col("s_g")), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", none).alias("ends_sha256"))
