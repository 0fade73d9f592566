"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of a bounded number of bytes, whole
texts each, and builds the word suffix array of a shard: by prefix doubling,
to the depth of the longest test text, beyond which no search can look. Each
suffix of the test texts is then located in each shard by binary search. Its
neighbours in the array hold its longest verbatim match; if that reaches the
window, two more searches bound the interval of all places where the window
occurs. Documents with such a place are affected.

Words are exact: they become numbers by a table of the test texts' words, and a
word outside that table ends a suffix, as nothing that holds it can match.

Text is never shuffled. The test texts reach the tasks in blocks of at most
``block_words`` words; each block is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm import _words
from adfunnel.llm._store import Scratch

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 1 << 20
PIECE_WORDS = 1 << 16

#: Letters in lower case, digits and bytes of characters beyond ASCII stay; all else is a space.
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
_PLAIN[0x41:0x5B] = _PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of ASCII letters, digits and characters beyond ASCII, and per text the place of its first one."""
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    if data is None:
        return _words.split(texts)
    ends = np.frombuffer(at, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = _PLAIN[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    kind = pa.LargeStringArray if large else pa.StringArray
    return _words.split(kind.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(plain.tobytes())))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``text`` with a number above 0, ordered by the numbers from there to the next 0, at least the first ``depth`` of them.

    Prefix doubling: the rank of a suffix by its first 2k numbers is the rank of
    (rank by the first k, rank of the suffix k on). Only suffixes that still
    share a rank and are not over before k are sorted again.
    """
    n = len(text)
    place = np.flatnonzero(text)
    if not len(place):
        return place
    stop = np.append(np.flatnonzero(text == 0), n)
    size = stop[np.searchsorted(stop, place)] - place
    bits = int(text.max()).bit_length()
    k = max(1, 62 // bits)  # so many numbers make the first key
    key, ahead = np.zeros(len(place), np.int64), np.append(text, np.zeros(k, text.dtype)).astype(np.int64)
    for j in range(k):
        key = (key << bits) | np.where(size > j, ahead[place + j], 0)
    order = np.argsort(key, kind="stable")
    array, key = place[order], key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.maximum.accumulate(np.where(first, np.arange(len(array)), 0))  # slot where the group of a slot begins
    rank = np.zeros(n + 1, np.int64)
    rank[array] = group + 1
    length = np.zeros(n + 1, np.int64)
    length[place] = size
    slots = np.arange(len(array))
    while k < depth:
        members = np.bincount(group, minlength=len(array))
        slots = slots[(members[group[slots]] > 1) & (length[array[slots]] >= k)]
        if not len(slots):
            break
        here = array[slots]
        key = group[slots] * (len(array) + 1) + rank[here + k]
        order = np.argsort(key, kind="stable")
        array[slots], key = here[order], key[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        group[slots] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        rank[array[slots]] = group[slots] + 1
        k *= 2
    return array


class Shard:
    """The suffix array of some texts, and searches in it."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.append(text, 0)
        self.array = suffix_array(self.text, depth)

    def common(self, query: np.ndarray, start: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many numbers of the query from ``start`` on stand at ``place`` too, up to ``most``; a 0 ends a match."""
        out = np.zeros(len(start), np.int64)
        left = np.flatnonzero(most > 0)
        while len(left):
            x = query[start[left] + out[left]]
            left = left[(x == self.text[place[left] + out[left]]) & (x > 0)]
            out[left] += 1
            left = left[out[left] < most[left]]
        return out

    def find(self, query: np.ndarray, start: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
        """The first slot whose suffix isn't below the first ``most`` numbers of the query from ``start`` on; with ``after`` the first above them."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.array))
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            q, p, m = start[open_], self.array[mid], most[open_]
            same = self.common(query, q, p, m)
            whole = same == m
            x, y = query[np.minimum(q + same, len(query) - 1)], self.text[p + same]
            below = np.where(whole, after, y < x)
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
        return low


class Tests:
    """One block of test texts: numbered words, their suffixes, and the windows that count as a match."""

    def __init__(self, pieces: pa.Table, window: int):
        words, at = _words.split(pieces.column("words").combine_chunks())
        self.table = pc.unique(words)
        number = pc.index_in(words, value_set=self.table).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        n = np.diff(at)
        self.query = np.zeros(len(number) + len(n), np.int32)
        self.query[np.arange(len(number)) + np.repeat(np.arange(len(n)), n)] = number
        self.piece = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(number)) - at[self.piece]  # in its piece
        self.start = np.arange(len(number)) + self.piece
        self.most = n[self.piece] - self.place
        self.need = np.minimum(window, pieces.column("n_words").to_numpy())[self.piece]
        self.offset = pieces.column("off").to_numpy()
        self.item = pieces.column("item").to_numpy()
        self.depth = int(n.max()) if len(n) else 0

    def numbers(self, words: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of some texts, a 0 after each text, and where each text begins."""
        found = pc.fill_null(pc.index_in(words, value_set=self.table), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        n = np.diff(at)
        out = np.zeros(len(found) + len(n), np.int32)
        out[np.arange(len(found)) + np.repeat(np.arange(len(n)), n)] = found
        return out, at[:-1] + np.arange(len(n))

    def longest(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Per suffix the length of its longest match in the shard, and a place of it."""
        size, place = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        if len(shard.array):
            slot = shard.find(self.query, self.start, self.most)
            for near in (slot - 1, slot):
                p = shard.array[np.clip(near, 0, len(shard.array) - 1)]
                same = shard.common(self.query, self.start, p, self.most)
                place, size = np.where(same > size, p, place), np.maximum(size, same)
        return size, place


def _pieces(bench: DataFrame, item_col: str, text_col: str, window: int, piece_words: int) -> DataFrame:
    """(item, off, n_words, words): test texts as words joined by a space; a long one as pieces that overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.chunks(batch, "text"):
                words, at = split(part.column("text"))
                rows = []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for off in range(0, max(1, b - a - window + 1) if b > a else 0, piece_words):
                        rows.append((i, off, b - a, a + off, min(b, a + off + piece_words + window - 1)))
                if not rows:
                    continue
                i, off, n, lo, hi = map(np.array, zip(*rows, strict=True))
                starts = np.concatenate(([0], np.cumsum(hi - lo)))
                take = np.arange(starts[-1]) + np.repeat(lo - starts[:-1], hi - lo)
                text = _words.joined(words.take(pa.array(take)), starts)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(i)), pa.array(off), pa.array(n), pa.array(text, pa.string())], ["item", "off", "n_words", "words"])

    own = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "item string, off bigint, n_words bigint, words string")


def _blocks(pieces: DataFrame, block_words: int) -> Iterator[pa.Table]:
    """The pieces in blocks; each is known to hold at most ``block_words`` words, or one piece, before it is read.

    Pieces are hashed to buckets, small enough each, and buckets are packed.
    """
    pieces = pieces.distinct()
    words = F.size(F.split("words", " "))
    total = pieces.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    n = 1 if total <= block_words else 4 * -(-total // block_words)
    while True:
        dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "off", "words"), F.lit(n)))
        sizes = dealt.groupBy("bucket").agg(F.sum(words).alias("n"), F.count("*").alias("k")).orderBy("bucket").collect()
        if n == 1 or all(r.n <= block_words or r.k == 1 for r in sizes):
            break
        n *= 2
    ranges, held = [[0, 0]], 0
    for r in sizes:
        if held and held + r.n > block_words:
            ranges.append([r.bucket, r.bucket])
            held = 0
        ranges[-1][1], held = r.bucket, held + r.n
    for lo, hi in ranges:
        yield dealt.where(F.col("bucket").between(lo, hi)).orderBy("item", "off", "words").toArrow()


def _shards(batches: Iterator[pa.RecordBatch], tests: Tests, shard_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Shard]]:
    """Rows of a shard, the first word of each text (one more than texts), where each text begins in the shard's numbers, and the shard."""
    for batch in batches:
        for part in _words.chunks(batch, "text", shard_bytes):
            words, at = split(part.column("text"))
            numbers, begin = tests.numbers(words, at)
            yield part, at, begin, Shard(numbers, tests.depth)


def _hits(tests: Tests, shard: Shard, begin: np.ndarray, n_words: np.ndarray) -> list[tuple[list, list]]:
    """Per text of the shard its stretches of hit words, and the test texts with a window in it."""
    out: list[tuple[list, list]] = [([], []) for _ in begin]
    size, _ = tests.longest(shard)
    hit = np.flatnonzero((size >= tests.need) & (tests.most >= tests.need))
    if not len(hit):
        return out
    need = tests.need[hit]
    low, high = shard.find(tests.query, tests.start[hit], need), shard.find(tests.query, tests.start[hit], need, after=True)
    edge = np.zeros(len(shard.text) + 1, np.int64)
    items: list[set[str]] = [set() for _ in begin]
    # equal windows have one interval
    order = np.lexsort((need, low))
    new = np.flatnonzero(np.concatenate(([True], (np.diff(low[order]) != 0) | (np.diff(need[order]) != 0))))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
        one = order[a]
        places = shard.array[low[one] : high[one]]
        np.add.at(edge, places, 1)
        np.add.at(edge, places + need[one], -1)
        own = set(tests.item[tests.piece[hit[order[a:b]]]])
        for text in np.unique(np.searchsorted(begin, places, side="right") - 1).tolist():
            items[text] |= own
    covered = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    rise, fall = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
    text = np.searchsorted(begin, rise, side="right") - 1
    for t, lo, hi in zip(text.tolist(), (rise - begin[text]).tolist(), (fall - begin[text]).tolist(), strict=True):
        out[t][0].append((lo, hi))
    return [(spans, sorted(own)) for (spans, _), own in zip(out, items, strict=True)]


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(id, n_words, hits, items) per row of ``docs``.

    ``hits`` are the stretches (begin, end) of words inside any occurrence of a
    window of the test texts, ``items`` the sorted ids, as strings, of test
    texts with an occurring window. A test text shorter than a window is one
    window; without words it has none. Null and empty texts have no words and
    no hits. Ids may be null, repeated and of any type: rows are told apart by
    position, or, with several blocks, by id and text, and rows that share both
    get equal results. Test texts that share an id are one item with the
    windows of all; a null item id is the empty string. Other columns are not
    read. Empty documents give an empty result, empty test texts no hits.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    pieces = scratch.save(_pieces(bench, item_col, bench_text_col, window, piece_words), "pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words bigint, hits array<struct<begin:int,end:int>>, items array<string>"
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def search(tests: Tests, carried: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, at, begin, shard in _shards(batches, tests, shard_bytes):
                hits, items = zip(*_hits(tests, shard, begin, np.diff(at)), strict=True)
                cols = [pa.array(np.diff(at), pa.int64()), pa.array(hits, spans_type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *cols], [*carried, "n_words", "hits", "items"])

        return run

    out = None
    for k, block in enumerate(_blocks(pieces, block_words)):
        tests = Tests(block, window)
        if k == 0:
            first, out = tests, own.mapInArrow(search(tests, ["id"]), schema)
            continue
        # more blocks: results of all are gathered by id and text, of documents with a hit only
        if k == 1:
            own = own.withColumn("f", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit(1), "text"))
            keyed = f"id {kind}, f bigint, g bigint, " + schema.split(", ", 1)[1]
            whole = scratch.save(own.mapInArrow(search(first, ["id", "f", "g"]), keyed), "block0")
            met = whole.where("size(items) > 0")
        met = met.unionByName(scratch.save(own.mapInArrow(search(tests, ["id", "f", "g"]), keyed).where("size(items) > 0"), f"block{k}"))
        out = None
    if out is not None:
        return out.withColumnRenamed("id", id_col)
    each = met.select("id", "f", "g", F.explode("hits").alias("h")).groupBy("id", "f", "g").agg(F.array_sort(F.collect_set("h")).alias("h"))
    # stretches that overlap or touch become one
    grown = F.expr("aggregate(h, cast(array() as array<struct<begin:int,end:int>>), (a, x) -> case when size(a) > 0 and x.begin <= a[size(a) - 1].end then concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].begin as begin, greatest(a[size(a) - 1].end, x.end) as end))) else concat(a, array(x)) end)")
    items = met.select("id", "f", "g", F.explode("items").alias("x")).groupBy("id", "f", "g").agg(F.array_sort(F.collect_set("x")).alias("all_items"))
    each = each.select(F.col("id").alias("i"), F.col("f").alias("p"), F.col("g").alias("q"), grown.alias("all_hits"))
    items = items.select(F.col("id").alias("i2"), F.col("f").alias("p2"), F.col("g").alias("q2"), "all_items")
    same = lambda i, p, q: F.col("id").eqNullSafe(F.col(i)) & (F.col("f") == F.col(p)) & (F.col("g") == F.col(q))
    out = whole.join(each, same("i", "p", "q"), "left").join(items, same("i2", "p2", "q2"), "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("all_hits", "hits").alias("hits"), F.coalesce("all_items", "items").alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns.

    A row goes if it shares its id (null included) and text with an affected
    one, so rows that share both go or stay together. Columns of ``docs`` keep
    their names whatever they are. Nulls, empty texts and empty tables as in
    ``find_contamination``.
    """
    names = [c.lower() for c in docs.columns]
    fresh = lambda x: next(n for n in (x + "_" * k for k in range(len(names) + 1)) if n not in names)
    i, f, g = fresh("at"), fresh("f"), fresh("g")
    key = F.col(id_col), F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)
    named = docs.select(F.struct(key[0].alias("i"), key[1].alias("f"), key[2].alias("g")).alias("at"), F.col(text_col).alias("text"))
    bad = find_contamination(named, bench, id_col="at", text_col="text", **params).where("size(items) > 0")
    bad = bad.select(F.col("at.i").alias(i), F.col("at.f").alias(f), F.col("at.g").alias(g)).distinct()
    return docs.join(bad, key[0].eqNullSafe(F.col(i)) & (key[1] == F.col(f)) & (key[2] == F.col(g)), "left_anti")


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item, item_start, length, id, doc_start): of each test suffix the longest verbatim match, where it reaches the window, and a place of it.

    Of places with equal lengths the one with the least id, then start, stays.
    In a test text longer than ``piece_words`` a match ends with its piece.
    Only matches that reach the window leave a task.
    """
    scratch = Scratch(docs.sparkSession, "longest")
    pieces = scratch.save(_pieces(bench, item_col, bench_text_col, window, piece_words), "pieces")
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["item", "item_start", "length", "id", "doc_start"]

    def search(tests: Tests):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, begin, shard in _shards(batches, tests, shard_bytes):
                size, place = tests.longest(shard)
                q = np.flatnonzero((size >= tests.need) & (tests.most >= tests.need))
                # of equal matches in the shard the first text's, then the first place
                low, high = shard.find(tests.query, tests.start[q], size[q]), shard.find(tests.query, tests.start[q], size[q], after=True)
                for a, b, k in zip(low.tolist(), high.tolist(), q.tolist(), strict=True):
                    every = shard.array[a:b]
                    text = np.searchsorted(begin, every, side="right") - 1
                    ids = part.column("id").take(pa.array(text))
                    least = pc.min(ids).as_py()
                    place[k] = every[pc.equal(ids, least).to_numpy(zero_copy_only=False) if least is not None else slice(None)].min()
                text = np.searchsorted(begin, place[q], side="right") - 1
                piece = tests.piece[q]
                yield pa.RecordBatch.from_arrays([pa.array(tests.item[piece], pa.string()), pa.array(tests.offset[piece] + tests.place[q]), pa.array(size[q]), part.column("id").take(pa.array(text)), pa.array(place[q] - begin[text])], names)

        return run

    out = None
    for block in _blocks(pieces, block_words):
        found = own.mapInArrow(search(Tests(block, window)), f"item string, item_start bigint, length bigint, id {kind}, doc_start bigint")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("item", "item_start").agg(F.min(F.struct((-F.col("length")).alias("n"), "id", "doc_start")).alias("m"))
    return best.select("item", "item_start", (-F.col("m.n")).alias("length"), F.col("m.id").alias(id_col), F.col("m.doc_start").alias("doc_start"))
