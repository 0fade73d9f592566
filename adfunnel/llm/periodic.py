"""Runs: stretches of consecutive words that repeat with a period.

Every run holds a Lyndon word, over the words in some order or in its reverse,
that begins at a place where it is the longest Lyndon word, and whose length is
the run's period. So the Lyndon arrays under both orders name all candidates,
and each is extended to both sides as far as words a period apart agree.

The Lyndon arrays come from phase one of Baier's suffix sorter: suffixes are
grouped by a prefix, at first their first word. Groups are taken from the
highest down; the prefix of each suffix that stands right before members of a
group grows by theirs. What phase one ends with, groups by longest Lyndon
prefix, is the Lyndon array; the second phase is not needed.

Phase one is plain Python, so a screen with whole arrays goes before it: in a
run of three periods and 24 words each 8 words in a row stand a period on or
back once more. Stretches not covered by 8 words that their document repeats
hold no run.

Each text is worked on by itself: nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm import _words

MIN_WORDS = 24
MIN_PERIODS = 3


def lyndon_array(text: list[int]) -> list[int]:
    """Per place the length of the longest Lyndon word that begins there (phase one of Baier's suffix sorter)."""
    n = len(text)
    symbols = sorted(set(text))
    at = {x: g for g, x in enumerate(symbols)}
    group = [at[x] for x in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(symbols)  # of each group's prefix
    lower = list(range(-1, len(symbols) - 1))  # the group below each,
    upper = [*range(1, len(symbols)), -1]  # and above
    open_ = list(range(n))  # leads to the nearest place at or before one that isn't in a finished group
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            open_[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and (q := open_[p]) != p:  # path halving
                if q >= 0:
                    open_[p] = q = open_[q]
                p = q
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if len(times) == 1:
            moved = [(k, group[p], [p]) for p, k in times.items()]
        else:
            alike: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, k in times.items():
                alike[k, group[p]].append(p)
            moved = [(k, h, ps) for (k, h), ps in sorted(alike.items(), reverse=True)]
        for k, h, ps in moved:  # most copies first, as each new group comes right above the old one
            new = len(size)
            size.append(size[h] + k * size[g])
            members.append(ps)
            above = upper[h]
            upper.append(above)
            lower.append(h)
            upper[h] = lower[above] = new
            for p in ps:
                group[p] = new
        members[g] = []
        g = lower[g]
    return [size[g] for g in group]


def _extend(text: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The longest stretch around ``i`` in which words ``p`` apart agree (as far as ``i`` and ``i + p`` do)."""
    n = len(text)
    end, step = i, 64
    while end + p < n:
        stop = min(end + step, n - p)
        differ = text[end:stop] != text[end + p : stop + p]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = stop, 2 * step
    start, step = i, 64
    while start > 0:
        stop = max(0, start - step)
        differ = (text[stop:start] != text[stop + p : start + p])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, step = stop, 2 * step
    return start, end + p


def runs(text: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_words`` words and ``min_periods`` (2 or more) periods, by start, then period."""
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    found: set[tuple[int, int, int]] = set()
    n = len(text)
    for order in (text, -text):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        place = np.arange(n)
        if min_periods > 2:  # then a run has a root with a whole second copy; here it's looked at by its ends
            place = place[place + 2 * period <= n]
            p = period[place]
            place = place[(text[place] == text[place + p]) & (text[place + p - 1] == text[place + 2 * p - 1])]
        last: dict[int, tuple[int, int]] = {}
        for i, p in zip(place.tolist(), period[place].tolist(), strict=True):
            start, end = last.get(p, (0, 0))
            if start <= i and i + p <= end:
                continue  # a further root of the run just found
            start, end = last[p] = _extend(text, i, p)
            if start <= i and end - start >= max(min_words, min_periods * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repeated(words: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Which words are covered by ``gram`` words in a row that their text holds twice or more."""
    n = len(words)
    cover = np.zeros(n + 1, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(np.arange(n) + gram <= np.repeat(at[1:], np.diff(at)))
    if len(start):
        value = _words.window_hashes(_words.mix(words.astype(np.uint64) + np.uint64(1)), gram)[start]
        value = _words.mix(value + _words.mix(text[start].astype(np.uint64)))
        order = np.argsort(value)
        value = value[order]
        same = value[1:] == value[:-1]
        start = start[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + gram, -1)
    return np.cumsum(cover[:n]) > 0


def _stretches(words: np.ndarray, at: np.ndarray, min_words: int, min_periods: int) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end) of the stretches that can hold runs, in order."""
    least = max(min_words, min_periods)
    # a run of n words and period p has n - gram + 1 places of gram words; with 2p or more each has another a period away
    gram = max(1, min(8, least - 2 * -(-least // min_periods) + 1))
    covered = _repeated(words, at, gram)
    edge = np.zeros(len(words) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate(([False], covered[:-1]))))
    end = np.flatnonzero(covered & (edge[1:] | ~np.concatenate((covered[1:], [False])))) + 1
    some = end - begin >= least
    begin, end = begin[some], end[some]
    yield from zip((np.searchsorted(at, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed) per row of ``docs``.

    ``runs`` are (start, length, period) by start, then period, in words from 0;
    ``collapsed`` is the text, words joined by one space, without the words that
    stand in a run after its first period. Null and empty texts have no words,
    no runs and an empty collapsed text. Ids may be null, repeated and of any
    type: rows are told apart by position. Other columns are not read. An empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "runs", "collapsed"]
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.chunks(batch, "text"):
                words, at = _words.split(part.column("text"))
                number = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
                gone = np.zeros(len(number) + 1, np.int64)
                for text, begin, end in _stretches(number, at, min_words, min_periods):
                    for start, length, period in runs(number[begin:end], min_words, min_periods):
                        found[text].append((int(begin + start - at[text]), length, period))
                        gone[begin + start + period] += 1
                        gone[begin + start + length] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(stay)))[at]
                if not stay.all():
                    words = words.filter(pa.array(stay))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at), pa.int64()), pa.array(found, runs_type), pa.array(_words.joined(words, left), pa.string())], names)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
