"""Embedding near-dedup with spherical-cap filters.

A filter is a direction; a vector belongs to it if its cosine with it exceeds
a cap. Directions are a random product code: after a random rotation the
coordinates fall into blocks, each block has some random unit vectors, and a
direction is one of these per block. So there are words ** blocks directions,
and list decoding finds those that a vector exceeds by extending its best
prefixes block by block, without looking at each direction. The cap is set per
vector so that it exceeds a stated number of directions of a code: with one cap
for all, some vectors exceed none and others thousands. Similar vectors share
filters: a join on filters brings them together, and every pair that meets is
verified by its cosine in double precision.

The code follows the dimension and the number of distinct vectors (``shape``):
directions grow with the rows, so that a random vector meets about as many
others at any size, and lists grow slowly with them, so that recall holds. Below
16 dimensions a block is a whole vector and the code is fixed: there a constant
share of random pairs is similar, so what meets grows with what is linked.
Share of pairs at a cosine of 0.9 that share a filter, as the tests measure it:
at least 0.985 from 1 to 1,024 dimensions up to 40,000 vectors, 0.95 from 24
dimensions on up to 10^9; lower for 16 to 23 dimensions above 2^22 vectors.

Filters whose directions begin alike lie next to each other: a *cell* is a
range of a code's directions, and a vector is sent once to a cell for all its
filters there, not once to each. It is sent as its column holds it, with its
filters up to the cell's end, so that a pair that meets in several filters is
counted at the least only. What is sent at a time is bounded: codes, and parts
of a code's cells, take turns (passes) so that no pass deals out more than
``PASS_SHARE`` times the bytes of the vectors. A cell with far more vectors than
others is cut into blocks, and pairs of blocks are the units of work; within a
unit a filter with many vectors is worked off by ``block_rows``.
Pairs are never emitted: a unit returns, per vector with links counted there,
their number and the least vector of its component there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from adfunnel.llm._graph import components
from adfunnel.llm._store import Scratch

CODES = 3
LOW_DIM = 16  # below it a code has one block
#: Directions of the one block by dimension; from the last on, the last.
LOW_WORDS = {1: 8, 2: 48, 3: 128, 4: 256, 5: 384, 6: 512, 7: 768, 8: 1024}
#: (rows up to, filters of a vector in a code); more rows: the last.
LISTS = [(1 << 11, 8), (1 << 17, 16), (1 << 22, 32), (1 << 62, 64)]
MET = 96  # about as many random vectors share a filter with a vector, over all codes
MAX_WORDS = 4096
BLOCK_ROWS = 512
#: Vectors of a cell: where more than MOST_ROWS are to be expected cells are made smaller; up to CELL_ROWS are one unit of work.
CELL_ROWS, MOST_ROWS = 1 << 14, 1 << 17
#: A pass deals out this many times the bytes of the vectors, or so many bytes at least.
PASS_SHARE, PASS_BYTES = 3, 1 << 28
#: In a filter of up to so many vectors pairs are listed, in larger ones multiplied out.
FEW = 32
MIN_COSINE = 0.9


def shape(dim: int, rows: int) -> tuple[int, int, int]:
    """(blocks, words a block, filters a vector) of a code for ``rows`` vectors of ``dim`` dimensions."""
    if dim < LOW_DIM:
        return 1, LOW_WORDS.get(dim, LOW_WORDS[max(LOW_WORDS)]), 8
    most = next(m for upto, m in LISTS if rows <= upto)
    directions = max(4096, CODES * most * most * rows // MET)
    # three blocks need dimensions enough to tell words apart
    blocks = 2 if directions <= MAX_WORDS**2 or dim < 4 * LOW_DIM else 3
    return blocks, min(MAX_WORDS, int(np.ceil(directions ** (1 / blocks)))), most


@cache
def code(dim: int, seed: int, blocks: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and, per block of rotated coordinates, unit vectors scaled so that a direction has length 1."""
    rng = np.random.default_rng([seed, dim, blocks, words])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    books = []
    for p in np.array_split(np.arange(dim), blocks):
        c = rng.standard_normal((words, len(p)))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks))
    return turn, books


def decode(x: np.ndarray, seed: int, blocks: int, words: int, most: int) -> np.ndarray:
    """Per unit row of ``x`` the ``most`` directions of the code with the greatest cosines.

    A direction among the best has a prefix among the best prefixes, and of
    each block a word among the best words, so no more than ``most`` prefixes
    are extended, each by ``most`` words.
    """
    turn, books = code(x.shape[1], seed, blocks, words)
    y = x @ turn
    edges = np.cumsum([0, *(b.shape[1] for b in books)])
    total, name = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for a, b, book in zip(edges[:-1], edges[1:], books, strict=True):
        near, best = _greatest(y[:, a:b] @ book.T, most)
        # the i-th prefix with the j-th word has i * j - 1 sums above it at least
        i, j = np.divmod(np.arange(total.shape[1] * near.shape[1]), near.shape[1])
        i, j = i[few := (i + 1) * (j + 1) <= most], j[few]
        total, keep = _greatest(total[:, i] + near[:, j], most)
        name = np.take_along_axis(name[:, i] * words + best[:, j], keep, 1)
    return name


def _greatest(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest values of each row, greatest first, and their columns."""
    n, width = x.shape
    most = min(most, width)
    at = np.flatnonzero(x >= np.partition(x, width - most, axis=1)[:, width - most, None])
    if len(at) == n * most:
        at = at.reshape(n, most) - np.arange(0, n * width, width)[:, None]
    else:  # some are equal
        at = np.argpartition(-x, most - 1, axis=1)[:, :most]
    values = np.take_along_axis(x, at, 1)
    order = np.argsort(-values, axis=1)
    return np.take_along_axis(values, order, 1), np.take_along_axis(at, order, 1)


def filters(x: np.ndarray, rows: int, codes: int = CODES) -> np.ndarray:
    """Per row of ``x`` its filters in the first ``codes`` codes, in order; a code's stand together."""
    blocks, words, most = shape(x.shape[1], rows)
    return np.concatenate([np.sort(decode(x, seed, blocks, words, most), axis=1) + seed * words**blocks for seed in range(codes)], axis=1)


def cells(dim: int, rows: int) -> tuple[int, int, int]:
    """(directions of a code, directions of a cell, vectors of a unit of work) for ``rows`` vectors.

    The directions of a cell begin with one word, which has about ten vectors
    for each that it would have if all had one.
    """
    blocks, words, _ = shape(dim, rows)
    cut = 1 + 10 * rows // (words * MOST_ROWS) if blocks > 1 else 1
    unit = max(CELL_ROWS, 20 * rows // (words * cut)) if blocks > 1 else CELL_ROWS
    return words**blocks, max(1, words ** (blocks - 1) // cut), unit


def runs(name: np.ndarray, dim: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, cell, begin, end) of each cell that a row of ``filters`` lies in: its filters there are those from begin to end."""
    directions, width, _ = cells(dim, rows)
    seed = np.arange(name.shape[1]) // shape(dim, rows)[2]
    cell = seed * -(-directions // width) + (name - seed * directions) // width
    row, begin = np.nonzero(np.diff(cell, axis=1, prepend=-1))
    end = np.append(begin[1:], 0)
    end[end == 0] = name.shape[1]
    return row, seed[begin], cell[row, begin], begin, end


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors of finite rows that aren't zero; a row is scaled by its greatest component first."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0


def _vectors(lists: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a column by dimension; rows that can't link are left out."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    ok = np.bincount(row[values.is_null().to_numpy(zero_copy_only=False)], minlength=len(size)) == 0
    if pa.types.is_floating(values.type) or pa.types.is_integer(values.type):
        flat = values.fill_null(0).to_numpy(zero_copy_only=False)
    else:
        flat = np.asarray([0 if v is None else v for v in values.to_pylist()], np.float64)
    first = np.cumsum(size) - size
    for dim in np.unique(size[ok & (size > 0)]).tolist():
        rows = np.flatnonzero(ok & (size == dim))
        x = flat[first[rows][:, None] + np.arange(dim)].astype(kind)
        fit = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield rows[fit], x[fit]


def _read(vectors: DataFrame, kind: str) -> DataFrame:
    """(id, f, x): the hash of the unit vector's bytes and the vector's own bytes; null where a vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, raw = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, x in _vectors(batch.column("embedding"), kind):
                for i, v, u in zip(rows.tolist(), x, _unit(x).astype("<f8"), strict=True):
                    raw[i] = v.tobytes()
                    f[i] = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(f, pa.binary()), pa.array(raw, pa.binary())], ["id", "f", "x"])

    return vectors.mapInArrow(run, "id bigint, f binary, x binary")


def _parts(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors) of a batch of classes, some rows at a time."""
    for at in range(0, batch.num_rows, 1024):
        raw = batch.column("x").slice(at, 1024).to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(kind).itemsize
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            yield dim, at + rows, _unit(np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(-1, dim))


def _number(dim: int, rows: int) -> str:
    """How filters are sent: without their code, which their place tells."""
    return "<u4" if cells(dim, rows)[0] <= 1 << 32 else "<u8"


def _count(classes: DataFrame, rows_all: int, kind: str) -> DataFrame:
    """(dim, cell, seed, blocks, bytes) per cell: blocks its rows are cut into, bytes it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _parts(batch, kind):
                _, seed, cell, _, end = runs(filters(x, rows_all), dim, rows_all)
                cell, first, at = np.unique(cell, return_index=True, return_inverse=True)
                old = found.setdefault(dim, [np.zeros(0, np.int64)] * 4)
                new = cell, seed[first], np.bincount(at), np.bincount(at, end).astype(np.int64)
                cell, first, at = np.unique(np.append(old[0], new[0]), return_index=True, return_inverse=True)
                sums = [np.bincount(at, np.append(old[k], new[k])).astype(np.int64) for k in (2, 3)]
                found[dim] = [cell, np.append(old[1], new[1])[first], *sums]
        for dim, (cell, seed, rows, names) in found.items():
            size = rows * (dim * np.dtype(kind).itemsize + 48) + names * np.dtype(_number(dim, rows_all)).itemsize
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(cell), dim), cell, seed, np.full(len(cell), cells(dim, rows_all)[2]), rows, size)], ["dim", "cell", "seed", "unit", "rows", "bytes"])

    counted = classes.select("x").mapInArrow(run, "dim bigint, cell bigint, seed bigint, unit bigint, rows bigint, bytes bigint")
    counted = counted.groupBy("dim", "cell", "seed", "unit").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.col("rows") / F.col("unit"))
    return counted.select("dim", "cell", "seed", blocks.cast("int").alias("blocks"), (F.col("bytes") * blocks).alias("bytes"))


def _post(classes: DataFrame, rows_all: int, kind: str, seeds: list[int], part: int = 0, parts: int = 1) -> DataFrame:
    """(dim, cell, id, n, x, own, begin) of each vector under each of its cells: one part of the cells of the codes ``seeds``.

    own: its filters up to the last in the cell, begin: the number of those before the cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _parts(batch, kind):
                name = filters(x, rows_all, max(seeds) + 1)
                row, seed, cell, begin, end = runs(name, dim, rows_all)
                own = (name - np.arange(name.shape[1]) // shape(dim, rows_all)[2] * cells(dim, rows_all)[0]).astype(_number(dim, rows_all))
                here = np.isin(seed, seeds) & (cell % parts == part)
                row, cell, begin, end = row[here], cell[here], begin[here], end[here]
                at = np.append(0, np.cumsum(end))
                own = own.ravel()[_ranges(row * name.shape[1], end)[1]]
                own = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((at * own.itemsize).astype(np.int32)), pa.py_buffer(own)])
                take = batch.take(pa.array(rows[row]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim), pa.int32()), pa.array(cell, pa.int64()), take.column("id"), take.column("n"), take.column("x"), own, pa.array(begin, pa.int32())], ["dim", "cell", "id", "n", "x", "own", "begin"])

    return classes.mapInArrow(run, "dim int, cell bigint, id bigint, n bigint, x binary, own binary, begin int")


def _deal(posts: DataFrame, counted: DataFrame) -> DataFrame:
    """Posts under their units of work (dim, cell, lo, hi); a cell of one block is one unit."""
    large = counted.where("blocks > 1").select("dim", "cell", "blocks")
    posts = posts.join(F.broadcast(large), ["dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posts = posts.withColumn("block", F.pmod(F.xxhash64("id", "cell"), F.col("blocks")).cast("int"))
    dealt = posts.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    return dealt.select("dim", "cell", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "id", "n", "x", "own", "begin", "block")


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, number) of the numbers of several ranges, one range after the other."""
    at = np.repeat(np.arange(len(size)), size)
    return at, np.arange(len(at)) + (first - np.cumsum(size) + size)[at]


class _Cell:
    """The rows of a unit of work, by id."""

    def __init__(self, t: pa.Table, rows_all: int, kind: str, block_rows: int):
        dim = t["dim"][0].as_py()
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        t = t.take(pc.sort_indices(t["id"]))
        self.block_rows = block_rows
        self.ids, self.n, begin, side = (t[c].to_numpy().astype(np.int64) for c in ("id", "n", "begin", "block"))
        self.x = _unit(np.frombuffer(b"".join(t["x"].to_pylist()), kind).reshape(-1, dim))
        raw = t["own"].to_pylist()
        form = _number(dim, rows_all)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(form).itemsize
        self.first = np.cumsum(self.size) - self.size
        self.row, place = _ranges(np.zeros(len(raw), np.int64), self.size)
        directions = cells(dim, rows_all)[0]
        #: Filters of the rows, one after the other, in order.
        self.own = np.frombuffer(b"".join(raw), form).astype(np.int64) + place // shape(dim, rows_all)[2] * directions
        self.span = CODES * directions
        self.side = side if lo != hi else None  # within a block is another unit's work
        # the posts of this cell by filter, then row
        posts = np.flatnonzero(place >= begin[self.row])
        self.posts = posts[np.argsort(self.own[posts], kind="stable")]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.links = np.zeros(len(raw), np.int64)

    def lower(self, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in ``post``, filter) of the filters that the rows of these posts have below them."""
        first = self.first[self.row[post]]
        at, place = _ranges(first, post - first)
        return at, self.own[place]

    def count(self, a: np.ndarray, b: np.ndarray) -> None:
        """Linked pairs of posts of one filter count unless they share a lower one."""
        for at in range(0, len(a), 4096):
            i, j = a[at : at + 4096], b[at : at + 4096]
            others, other = np.unique(j, return_inverse=True)
            row, name = self.lower(others)
            there = row * self.span + name
            pair, name = self.lower(i)
            key = other[pair] * self.span + name
            shared = np.zeros(len(i), bool)
            if len(there):
                shared[pair[there[np.minimum(np.searchsorted(there, key), len(there) - 1)] == key]] = True
            i, j = self.row[i[~shared]], self.row[j[~shared]]
            np.add.at(self.links, i, self.n[j])
            np.add.at(self.links, j, self.n[i])
            self.pairs.append((i, j))

    def few(self, begin: np.ndarray, size: np.ndarray, least: float) -> None:
        """Filters of few vectors, of one size: pairs are listed."""
        for g in np.unique(size).tolist():
            i, j = np.triu_indices(g, 1)
            group = begin[size == g]
            step = max(1, (1 << 16) // len(i))
            for at in range(0, len(group), step):
                a, b = (self.posts[(group[at : at + step, None] + k).ravel()] for k in (i, j))
                if self.side is not None:
                    a, b = a[cross := self.side[self.row[a]] != self.side[self.row[b]]], b[cross]
                linked = np.einsum("ij,ij->i", self.x[self.row[a]], self.x[self.row[b]]) >= least
                self.count(a[linked], b[linked])

    def many(self, post: np.ndarray, least: float) -> None:
        """A filter of many vectors, block by block."""
        blocks = [post[at : at + self.block_rows] for at in range(0, len(post), self.block_rows)]
        for k, p in enumerate(blocks):
            for q in blocks[k:]:
                i, j = self.row[p], self.row[q]
                linked = self.x[i] @ self.x[j].T >= least
                if p is q:
                    linked = np.triu(linked, 1)
                if self.side is not None:
                    linked &= self.side[i][:, None] != self.side[j][None, :]
                a, b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if linked.sum() <= 4 * (len(a) + len(b)):
                    a, b = np.nonzero(linked)
                    self.count(p[a], q[b])
                    continue
                linked, i, j = linked[np.ix_(a, b)], i[a], j[b]
                counted = linked & ~self.share(p[a], q[b])
                np.add.at(self.links, i, counted @ self.n[j])
                np.add.at(self.links, j, self.n[i] @ counted)
                square = np.zeros((len(a) + len(b),) * 2, bool)
                square[: len(a), len(a) :] = counted
                label = _labels(square | square.T)
                both = np.append(i, j)
                self.pairs.append((both[other := label != np.arange(len(label))], both[label[other]]))

    def share(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether posts of one filter share a lower filter, as a matrix."""
        (a, u), (b, v) = self.lower(p), self.lower(q)
        names = np.intersect1d(u, v)
        has = []
        for n, at, name in ((len(p), a, u), (len(q), b, v)):
            both = np.isin(name, names)
            m = np.zeros((n, len(names)), np.float32)
            m[at[both], np.searchsorted(names, name[both])] = 1
            has.append(m)
        return has[0] @ has[1].T > 0.5

    def found(self, least: float) -> pa.Table:
        begin = np.flatnonzero(np.diff(self.own[self.posts], prepend=-1))
        size = np.diff(np.append(begin, len(self.posts)))
        few = (size > 1) & (size <= FEW)
        self.few(begin[few], size[few], least)
        for k in np.flatnonzero(size > FEW):
            self.many(self.posts[begin[k] : begin[k] + size[k]], least)
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in self.pairs)]) for k in (0, 1))
        label = np.arange(len(self.ids))
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            for x in (a, b, label[a], label[b]):
                np.minimum.at(label, x, low)
            label = label[label]
        some = np.unique(np.append(a, b))
        return pa.table([pa.array(c[some], pa.int64()) for c in (self.ids, self.links, self.ids[label])], ["id", "links", "other"])


def _verify(dealt: DataFrame, least: float, rows_all: int, kind: str, block_rows: int) -> DataFrame:
    """(id, links, other) per vector with links counted in a unit of work: their number, and a vector of its component there."""

    def unit(t: pa.Table) -> pa.Table:
        return _Cell(t, rows_all, kind, block_rows).found(least)

    return dealt.groupBy("dim", "cell", "lo", "hi").applyInArrow(unit, "id bigint, links bigint, other bigint")


def passes(size: dict[int, int], most: int) -> list[tuple[list[int], int, int]]:
    """(codes, part, parts) of each pass, so that none deals out much more than ``most`` of the bytes of the codes."""
    if sum(size.values()) <= most:
        return [(list(range(CODES)), 0, 1)]
    return [([seed], part, parts) for seed in sorted(size) for parts in [-(-size[seed] // most)] for part in range(parts)]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    Linked are vectors of equal dimension found with a cosine of at least
    ``min_cosine``. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing. Equal directions (bit by bit
    after scaling) are one class with a count: its copies are linked with each
    other and share the links of the class. Rows that share an id are one
    vertex each with its own links. A row without an id links with nothing and
    is kept. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding"))
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    read = scratch.save(_read(own, kind), "read")
    valid = read.where("id is not null and f is not null")
    # equal vectors have equal bytes once scaled
    classes = valid.groupBy("f").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("x").alias("x"))
    classes = scratch.save(classes, "classes")
    read = scratch.save(read.drop("x"), "rows")
    scratch.drop("read")
    rows, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.length("x") + 48), F.lit(0))).first()
    vectors_in = classes.select("id", "n", "x")
    counted = scratch.save(_count(vectors_in, rows, kind), "cells")
    found = []
    for seeds, part, parts in passes({r.seed: r.bytes for r in counted.groupBy("seed").agg(F.sum("bytes").alias("bytes")).collect()}, max(PASS_BYTES, PASS_SHARE * size)):
        dealt = _deal(_post(vectors_in, rows, kind, seeds, part, parts), counted)
        found.append(scratch.save(_verify(dealt, min_cosine, rows, kind, block_rows), f"found-{len(found)}"))
    found = reduce(DataFrame.union, found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch, "graph")
    named = classes.select("f", "n", F.col("id").alias("rep")).join(links.withColumnRenamed("id", "l"), F.col("rep") == F.col("l"), "left").join(roots.withColumnRenamed("id", "r"), F.col("rep") == F.col("r"), "left")
    named = named.select("f", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = read.withColumn("f", F.when(F.col("id").isNotNull(), F.col("f"))).join(named, "f", "left")
    out = out.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
