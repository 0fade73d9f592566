"""MinHash near-dedup by a signature-coordinate inverted join.

A text's set of word shingles has a signature of ``COORDINATES`` minima. Two
texts with similarity s agree on each coordinate with chance s, so texts at or
above the threshold agree on at least ``MIN_MATCHES`` of them (a pair at 0.8
misses that once in some 100,000, one at 0.85 once in ten billion). Each text
is posted under its coordinate-value pairs:

* Screen: posting every text under every pair would shuffle the corpus many
  times over. Coordinates joined by threes are seldom shared by chance, so only
  texts that share ``MIN_JOINED`` of ``JOINED`` such values with some other text
  go on (a pair at 0.8 misses that once in ten million).
* Prefix: pairs are ordered by how many texts have them, rarest first. Texts
  that agree on MIN_MATCHES pairs share one of the first COORDINATES -
  MIN_MATCHES + 1 of each. Pairs that one text has alone take the first places
  for nothing; most texts have no more than these and are done.
* Skip: the frequent rest of the pairs is never merged. It is looked up in the
  signatures of a candidate pair, whose collisions are counted there in full.
* Texts that keep MIN_MATCHES collisions are compared on their full sets.

A list of a hundred thousand near copies isn't expanded into pairs. Its texts
are first compared with the least text of the list. Those that keep
MIN_MATCHES collisions with it make a cluster, those confirmed make a
component. Within a cluster, texts outside its largest component are compared
with all in blocks, on full sets, as products of incidence matrices; a block
returns spanning links, not pairs. Texts that share a list but no cluster are
compared in blocks too, by their collisions. So every pair that shares a place in its prefixes is
tested unless it is known to be connected. Texts with equal sets are one text
throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm import _words
from adfunnel.llm._graph import components
from adfunnel.llm._store import Scratch

COORDINATES, MIN_MATCHES = 192, 128
JOINED, EACH, MIN_JOINED = 32, 3, 3
SIMILAR_PERCENT = 80


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes of one text's word hashes; fewer than k words are one shingle, none are none."""
    return np.unique(_words.window_hashes(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240, seed])
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signatures(docs: DataFrame, k: int, n: int, minima: int = 1, seed: int = 0) -> DataFrame:
    """(id, n_shingles, f, g, sig) per row of (id, text): set size, 128-bit hash of the set, and n values of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(n * minima, seed)
        for batch in batches:
            for part in _words.chunks(batch, "text", 1 << 19):
                words, at = _words.split(part.column("text"), lower=True)
                h = _words.hashes(words)
                sets = [_shingles(h[i:j], k) for i, j in zip(at[:-1], at[1:], strict=True)]
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(size)
                sig = np.zeros((len(sets), n), np.int32)
                f, g = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    begin = (np.cumsum(size) - size)[full]
                    f[full] = np.add.reduceat(_words.mix(flat ^ np.uint64(0xA5A5A5A5)), begin)
                    g[full] = np.add.reduceat(_words.mix(flat + np.uint64(0x5BD1E995)), begin)
                    for c in range(n):
                        value = np.zeros(len(full), np.uint64)
                        for o in range(c * minima, (c + 1) * minima):
                            value = _words.mix(value + np.minimum.reduceat(flat * a[o] + b[o], begin))
                        sig[full, c] = (value >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, n), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), lists], ["id", "n_shingles", "f", "g", "sig"])

    return docs.mapInArrow(run, "id bigint, n_shingles bigint, f bigint, g bigint, sig array<int>")


def _tokens(signed: DataFrame, *cols: str) -> DataFrame:
    """A row per text and coordinate, with the coordinate-value pair in one long."""
    each = signed.select(*cols, F.posexplode("sig").alias("c", "v"))
    return each.select(*cols, (F.shiftleft(F.col("c").cast("bigint"), 32) + F.col("v").cast("bigint") + F.lit(1 << 31)).alias("token"))


def screened(reps: DataFrame, least: int) -> DataFrame:
    """Ids of texts that share at least ``least`` values with others."""
    each = _tokens(reps, "id")
    often = each.groupBy("token").agg(F.count("*").alias("often")).where("often > 1").select("token")
    return each.join(often, "token").groupBy("id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("id")


def prefixes(signed: DataFrame, n: int, least: int) -> DataFrame:
    """(token, id, n): each text, with its set size, under the pairs of its prefix that another text has too."""
    each = _tokens(signed, "id", "n_shingles")
    often = each.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    own = each.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("own"), F.max("n_shingles").alias("n"))
    # pairs of this text alone come first in its order and leave that many places fewer
    left = F.lit(n - least + 1) - (F.lit(n) - F.size("own"))
    own = own.where(left > 0).select("id", "n", F.explode(F.slice("own", F.lit(1), left)).alias("p"))
    return own.select(F.col("p.token").alias("token"), "id", "n")


def _compare(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the (a, b, text_a, text_b) rows whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(texts: pa.Array) -> list[np.ndarray]:
            coded = texts.dictionary_encode()  # a text that many pairs share is read once
            words, at = _words.split(coded.dictionary, lower=True)
            h = _words.hashes(words)
            each = [_shingles(h[p:q], k) for p, q in zip(at[:-1], at[1:], strict=True)]
            return [each[i] for i in coded.indices.to_pylist()]

        for batch in batches:
            for part in _words.chunks(batch, "text_a", 1 << 20):
                for few in _words.chunks(part, "text_b", 1 << 20):
                    mask = []
                    for x, y in zip(sets(few.column("text_a")), sets(few.column("text_b")), strict=True):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        mask.append(100 * both >= percent * (len(x) + len(y) - both))
                    yield pa.RecordBatch.from_arrays([few.column("a"), few.column("b")], ["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, x in enumerate(sets):
        at = np.searchsorted(columns, x)
        at = at[at < len(columns)]
        out[i, at[columns[at] == x[: len(at)]]] = 1
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` are similar, by exact counts."""
    columns = np.intersect1d(np.concatenate(left), np.concatenate(right))
    both = np.zeros((len(left), len(right)), np.float64)
    for k in range(0, len(columns), 4096):
        some = columns[k : k + 4096]
        both += _incidence([x[(x >= some[0]) & (x <= some[-1])] for x in left], some) @ _incidence([x[(x >= some[0]) & (x <= some[-1])] for x in right], some).T
    size = np.fromiter(map(len, left), float, len(left))[:, None] + np.fromiter(map(len, right), float, len(right))
    return 100 * both >= percent * (size - both)


def _compare_blocks(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) spanning links of each unit of (cluster, i, j, out, id, text) rows, which arrive ordered by unit: texts with out against those without."""

    def unit(rows: list[tuple]) -> tuple[list, list]:
        words, at = _words.split(pa.array([t for _, _, t in rows], pa.string()), lower=True)
        h = _words.hashes(words)
        sets = [_shingles(h[p:q], k) for p, q in zip(at[:-1], at[1:], strict=True)]
        left, right = [i for i, r in enumerate(rows) if r[0]], [i for i, r in enumerate(rows) if not r[0]]
        a: list = []
        b: list = []
        if left and right:
            mask = _linked([sets[i] for i in left], [sets[i] for i in right], percent)
            parent = list(range(len(left) + len(right)))

            def top(i: int) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for i, j in zip(*(x.tolist() for x in np.nonzero(mask)), strict=True):
                p, q = top(i), top(len(left) + j)
                if p != q:  # a link that joins what was apart
                    parent[p] = q
                    a.append(rows[left[i]][1])
                    b.append(rows[right[j]][1])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            a: list = []
            b: list = []
            cols = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "out", "id", "text")]
            for c, i, j, out, id_, text in zip(*cols, strict=True):
                if (c, i, j) != key:
                    x, y = unit(held)
                    a += x
                    b += y
                    held, key = [], (c, i, j)
                held.append((out, id_, text))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = unit(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _within(placed: DataFrame, texts: DataFrame, k: int, percent: int, block: int = 256) -> DataFrame:
    """(a, b) links inside clusters of (id, cluster, root) rows, between the largest component of a cluster and the rest and among the rest."""
    size = placed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    size = size.groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main")).where("main.n < all")
    size = size.select("cluster", F.col("main.root").alias("main"), F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("main.n")) / block).cast("int").alias("outs"))
    rows = placed.join(size, "cluster").withColumn("out", F.col("root") != F.col("main")).join(texts.withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.select("cluster", every("outs").alias("i"), spread("blocks").alias("j"), F.lit(False).alias("out"), "id", "text")
    left = rows.where("out").select("cluster", spread("outs").alias("i"), every("blocks").alias("j"), "out", "id", "text")
    dealt = left.union(right).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return _compare_blocks(dealt, k, percent).where("a <> b")


def _across(placed: DataFrame, sigs: DataFrame, least: int, percent: int, block: int = 256) -> DataFrame:
    """(a, b) of texts of one list (token, id, n, root) and different clusters with ``least`` collisions.

    The texts of a list are dealt to blocks, and the collisions of two blocks
    are counted in one task from the signatures; only pairs that keep enough
    leave it.
    """
    open_ = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_ = open_.select("token", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = placed.join(open_, "token").join(sigs.withColumnRenamed("id", "s_id"), F.col("id") == F.col("s_id"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.select("token", "root", "id", "n", "sig", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "id", "n", "sig")

    def unit(token: int, i: int, j: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        sides, root, ids, n = (np.array(x) for x in list(zip(*rows, strict=True))[:4])
        sig = np.stack([r[4] for r in rows])
        left, right = np.flatnonzero(sides == i), np.flatnonzero(sides == j)
        same = np.zeros((len(left), len(right)), np.int16)
        for c in range(sig.shape[1]):
            same += sig[left, c][:, None] == sig[right, c]
        p, q = np.nonzero(same >= least)
        p, q = left[p], right[q]
        # else the union is too large, or one place is compared with itself or twice
        ok = (root[p] != root[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])) & ((i != j) | (p < q))
        p, q = ids[p[ok]], ids[q[ok]]
        return np.minimum(p, q), np.maximum(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 2]
            keys = zip(*(batch.column(c).to_pylist() for c in ("token", "i", "j")), strict=True)
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "root", "id", "n", "sig")]
            for at, row in zip(keys, zip(*cols, strict=True), strict=True):
                if at != key:
                    if held:
                        out.append(unit(*key, held))
                    held, key = [], at
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in unit(*key, held)], ["a", "b"])

    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = SIMILAR_PERCENT, coordinates: int = COORDINATES, min_matches: int = MIN_MATCHES) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Texts are lower-cased in A-Z. Linked are texts with 100 * intersection >=
    percent * union of their shingle sets; component_id is the least id that
    links reach, kept says that a row's id is that. A text with fewer words
    than a shingle is one shingle; null and empty texts have none and link
    with nothing. Rows that share an id are one vertex. A row without an id
    links with nothing and is kept. Ids are integers; other columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    read = scratch.save(signatures(own, shingle_words, JOINED, EACH), "read")
    sets = read.where("id is not null and n_shingles > 0")
    classes = scratch.save(sets.groupBy("f", "g").agg(F.min("id").alias("rep")), "classes")
    reps = sets.join(classes, ["f", "g"]).where("id = rep").select("id", "sig")
    ids = screened(reps, MIN_JOINED).withColumnRenamed("id", "i")
    texts = scratch.save(own.join(ids, F.col("id") == F.col("i"), "left_semi"), "texts")
    sigs = scratch.save(signatures(texts, shingle_words, coordinates, seed=1).select("id", "n_shingles", "sig"), "sigs")
    prefix = scratch.save(prefixes(sigs, coordinates, min_matches), "prefix")

    def matched(pairs: DataFrame) -> DataFrame:
        one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
        two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
        same = F.expr("aggregate(zip_with(sig_a, sig_b, (x, y) -> int(x = y)), 0, (n, x) -> n + x)")
        return pairs.join(one, "a").join(two, "b").where(same >= min_matches).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return _compare(both, shingle_words, percent)

    def of(ids: DataFrame, graph: DataFrame, name: str) -> DataFrame:
        graph = graph.select(F.col("id").alias("g_id"), F.col("root").alias(name))
        return ids.join(graph, F.col("id") == F.col("g_id"), "left").withColumn(name, F.coalesce(name, "id")).drop("g_id")

    sizes = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"  # noqa: E731  else the union is too large
    least = prefix.groupBy("token").agg(F.min(F.struct("id", "n")).alias("least")).select("token", F.col("least.id").alias("a"), F.col("least.n").alias("n_a"))
    pairs = prefix.join(least, "token").where("a < id").where(sizes("n", "n_a")).select("a", F.col("id").alias("b")).distinct()
    pairs = scratch.save(matched(pairs), "pairs0")
    links = scratch.save(confirmed(pairs), "links0")
    clusters, roots = components(pairs, scratch, "cluster"), components(links, scratch, "root")
    inside = scratch.save(_within(of(clusters.select("id", F.col("root").alias("cluster")), roots, "root"), texts, shingle_words, percent), "links1")
    # lists with texts of several clusters: the pairs across these
    placed = scratch.save(of(prefix, clusters, "root"), "placed")
    more = scratch.save(confirmed(_across(placed, sigs.select("id", "sig"), min_matches, percent).distinct()), "links2")
    final = components(links.union(inside).union(more), scratch, "final")
    named = classes.join(final, F.col("rep") == F.col("id"), "left").select("f", "g", F.coalesce("root", "rep").alias("root"))
    out = read.join(named, ["f", "g"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
