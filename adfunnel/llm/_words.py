"""Vectorised word splitting and hashing of Arrow text batches.

A word is a maximal run of characters other than space and U+0009..U+000D,
which is what Arrow's ASCII white-space split yields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 steps)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < n:
        begin = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and per text the place of its first word (one more entry than texts). A null has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full, min_count=0).as_py():  # white space at an end leaves an empty string
        doc = np.repeat(np.arange(len(texts)), counts)
        mask = full.to_numpy(zero_copy_only=False)
        counts = np.bincount(doc[mask], minlength=len(texts)).astype(np.int64)
        words = words.filter(full)
    return words, np.concatenate(([0], np.cumsum(counts)))


def _byte_values(key: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value for each place << 8 | byte."""
    return mix((key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_VALUES = _byte_values(np.arange(64 << 8))


def hashes(words: pa.Array, block: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word (none is empty): the mixed sum of the values of its bytes by their places in it."""
    out = np.zeros(len(words), np.uint64)
    if not len(words):
        return out
    _, at, data = words.buffers()
    ends = np.frombuffer(at, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    for k in range(0, len(words), block):
        some = ends[k : k + block + 1]
        size = np.diff(some)
        key = np.arange(some[0], some[-1])
        key -= np.repeat(some[:-1], size)
        key <<= 8
        key += data[some[0] : some[-1]]
        value = _VALUES.take(key, mode="clip")
        far = np.flatnonzero(key >= len(_VALUES))
        value[far] = _byte_values(key[far])
        out[k : k + block] = np.add.reduceat(value, some[:-1] - some[0])
    return mix(out)


def joined(words: pa.Array, starts: np.ndarray) -> list[str]:
    """The words of each text joined by one space."""
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)
    return pc.binary_join(lists, " ").to_numpy(zero_copy_only=False).tolist() if len(starts) > 1 else []


def window_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each word on (shorter by k - 1 than the input; windows may cross texts)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hash[i : i + n]
    return mix(out)


def sliding(x: np.ndarray, w: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) over the w values from each place on; shorter by w - 1."""
    n, step = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * step <= w:  # of windows of step values to windows of twice as many
        x, step = of(x[:-step], x[step:]), 2 * step
    return of(x[:n], x[w - step : w - step + n])
