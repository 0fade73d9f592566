"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves until no piece is longer than ``piece_chars``.
The pieces are rows: Spark deals them out and each is encoded by itself. Then
neighbours are joined pair by pair. Only what stands next to a cut can be
wrong, so a window around the join is encoded again and grows until its ids
agree with the left side before the cut and with the right side after it.
Texts of up to ``piece_chars`` characters are one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm import _words
from adfunnel.llm._bpe import WordCoder

_SPACE = " \t\n\x0b\x0c\r"
#: Ids that both sides of a join must share in a row at each edge of the window.
_AGREE = 4


class Piece:
    """A stretch of text with its ids, and the character span of each id.

    Spans are needed only near a join inside a long run without white space;
    elsewhere a run is encoded whole.
    """

    def __init__(self, coder: WordCoder, text: str, ids: np.ndarray | None = None):
        self.coder, self.text = coder, text
        self.ids = coder.encode(pa.array([text]))[0] if ids is None else ids


def _last_run(text: str, most: int) -> int:
    """Where the run of non-white characters at the end begins, looked for in the last ``most`` characters; -1: not there."""
    tail = text[-most:]
    for i in range(len(tail) - 1, -1, -1):
        if tail[i] in _SPACE:
            return len(text) - len(tail) + i + 1
    return 0 if len(tail) == len(text) else -1


def _first_run(text: str, most: int) -> int:
    """Where the run of non-white characters at the start ends, likewise."""
    for i, c in enumerate(text[:most]):
        if c in _SPACE:
            return i
    return len(text) if most >= len(text) else -1


def _spans(coder: WordCoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    e = coder.tok.encode(text, add_special_tokens=False)
    return np.asarray(e.ids, np.int64), np.asarray(e.offsets, np.int64).reshape(-1, 2)


def _common(a_ids, a_at, b_ids, b_at, last: bool) -> tuple[int, int] | None:
    """Places (i, j) in two encodings of the same text, such that _AGREE ids with equal spans stand from them on; the last such pair, or the first."""
    where = {(int(s), int(e), int(x)): j for j, ((s, e), x) in enumerate(zip(b_at, b_ids, strict=True))}
    order = range(len(a_ids) - _AGREE, -1, -1) if last else range(len(a_ids) - _AGREE + 1)
    for i in order:
        j = where.get((int(a_at[i][0]), int(a_at[i][1]), int(a_ids[i])))
        if j is None or j + _AGREE > len(b_ids):
            continue
        same = (a_ids[i : i + _AGREE] == b_ids[j : j + _AGREE]).all() and (a_at[i : i + _AGREE] == b_at[j : j + _AGREE]).all()
        # the ids must cover text one after the other: bytes of one character share a span
        if same and (a_at[i + 1 : i + _AGREE, 0] >= a_at[i : i + _AGREE - 1, 1]).all() and (a_at[i : i + _AGREE, 0] < a_at[i : i + _AGREE, 1]).all():
            return i, j
    return None


def join_runs(coder: WordCoder, left: str, right: str, first_window: int = 64) -> np.ndarray:
    """Ids of ``left + right``, a run without white space that was cut between them.

    The window reaches ``w`` characters to either side of the cut. Its ids are
    spliced in where they share several ids with the whole left half before the
    cut and with the whole right half after it. If they don't, ``w`` is
    doubled; a window over everything is the plain encoding.
    """
    a_ids, a_at = _spans(coder, left)
    b_ids, b_at = _spans(coder, right)
    w = first_window
    while w < max(len(left), len(right)):
        lo, hi = max(0, len(left) - w), min(len(right), w)
        x_ids, x_at = _spans(coder, left[lo:] + right[:hi])
        cut = len(left) - lo
        before, after = x_at[:, 1] <= cut - w // 4, x_at[:, 0] >= cut + w // 4
        n_before, n_after = int(before.sum()), int(after.sum())
        near = np.flatnonzero(a_at[:, 0] >= lo)
        far = np.flatnonzero(b_at[:, 1] <= hi)
        if n_before and n_after and len(near) and len(far):
            p = _common(x_ids[:n_before], x_at[:n_before], a_ids[near], a_at[near] - lo, last=True) if lo else (0, 0)
            x_far = len(x_ids) - n_after
            q = _common(x_ids[x_far:], x_at[x_far:], b_ids[far], b_at[far] + cut, last=False) if hi < len(right) else (0, 0)
            if p and q:
                head = a_ids[: near[0] + p[1]] if lo else a_ids[:0]
                tail = b_ids[q[1] :] if hi < len(right) else b_ids[:0]
                stop = x_far + q[0] if hi < len(right) else len(x_ids)
                return np.concatenate((head, x_ids[p[0] : stop], tail)).astype(coder.dtype)
        w *= 2
    return _spans(coder, left + right)[0].astype(coder.dtype)


def join(a: Piece, b: Piece) -> Piece:
    """The piece of both texts.

    The window first grows to the white space on both sides of the cut: there
    the tokenizer starts afresh, so both sides agree exactly. What stands
    outside keeps its ids; the run across the cut gets those of its own join.
    """
    coder = a.coder
    text = a.text + b.text
    if not a.text or not b.text or a.text[-1] in _SPACE or b.text[0] in _SPACE:
        return Piece(coder, text, np.concatenate((a.ids, b.ids)))
    w = 64
    while (i := _last_run(a.text, w)) < 0:
        w *= 2
    w = 64
    while (j := _first_run(b.text, w)) < 0:
        w *= 2
    left, right = a.text[i:], b.text[:j]
    n_left = len(coder.encode(pa.array([left]))[0])
    n_right = len(coder.encode(pa.array([right]))[0])
    inner = join_runs(coder, left, right)
    return Piece(coder, text, np.concatenate((a.ids[: len(a.ids) - n_left], inner, b.ids[n_right:])))


def tree_join(pieces: list[Piece]) -> Piece:
    """All pieces of a text, neighbours first."""
    while len(pieces) > 1:
        pieces = [join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def digests(coder: WordCoder, ids: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, and the SHA-256 of the ids (32 bits each) and of the decoded text."""
    decoded = b" ".join(map(coder.tokens.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def decode(coder: WordCoder, ids: np.ndarray) -> str:
    """The tokenizer's own decoding, special tokens included.

    Without a decoder of its own a file joins the tokens by spaces; with one
    the library decodes.
    """
    if coder.tok.decoder is None:
        return b" ".join(map(coder.tokens.__getitem__, ids.tolist())).decode()
    return coder.tok.decode(ids.tolist(), skip_special_tokens=False)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 16384, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) per row of ``docs``.

    Null and empty texts have no ids and the digests of nothing. A null or
    repeated id is carried as it is: rows are told apart by position. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    names = [f.split(" ")[0] for f in out.split(", ")]

    def row(coder: WordCoder, ids: np.ndarray) -> tuple:
        if coder.tok.decoder is None:
            got = digests(coder, ids)
        else:
            got = len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(coder, ids).encode()).hexdigest()
        return (*got, ids.astype(np.int32), decode(coder, ids)) if with_ids else got

    def batch_of(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder.of(tokenizer)
        for batch in batches:
            for part in _words.chunks(batch, "text"):
                ids, at = coder.encode(part.column("text"))
                yield batch_of(part.column("id"), [row(coder, ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder.of(tokenizer)
        for batch in batches:
            for part in _words.chunks(batch, "text"):
                ids, at = coder.encode(part.column("text"))
                raw = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "ids"])

    def joined(table: pa.Table) -> pa.Table:
        coder = WordCoder.of(tokenizer)
        table = table.sort_by("i")
        parts = [Piece(coder, t, np.frombuffer(x, coder.dtype)) for t, x in zip(table.column("text").to_pylist(), table.column("ids").to_pylist(), strict=True)]
        return pa.Table.from_batches([batch_of(table.column("id").combine_chunks().slice(0, 1), [row(coder, tree_join(parts).ids)])])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    short = own.where(F.coalesce(F.length("text"), F.lit(0)) <= piece_chars)
    # as many halves of halves as bring a piece under the limit
    n = F.pow(F.lit(2.0), F.ceil(F.log2(F.length("text") / piece_chars))).cast("int")
    long = own.where(F.length("text") > piece_chars).select("id", "text", F.monotonically_increasing_id().alias("row"), n.alias("n"))
    cut = long.select("id", "row", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    cut = cut.select("id", "row", "i", F.expr("substring(text, int(i * bigint(length(text)) div n) + 1, int((i + 1) * bigint(length(text)) div n) - int(i * bigint(length(text)) div n))").alias("text"))
    coded = cut.repartition("row", "i").mapInArrow(pieces, f"id {kind}, row bigint, i int, text string, ids binary")
    tree = coded.groupBy("row").applyInArrow(joined, out)
    return short.mapInArrow(whole, out).unionByName(tree).withColumnRenamed("id", id_col)
