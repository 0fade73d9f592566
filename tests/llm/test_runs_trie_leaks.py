"""Decontamination, periodic runs and the conversation trie against plain re-computation."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adfunnel.llm import decontaminate, periodic, queries, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _plain(t):
    return PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


# decontamination


@pytest.fixture(scope="module")
def leaks():
    """Documents and test texts over few words, so that windows overlap, repeat and end at edges."""
    rng = random.Random(3)
    few = lambda n, k=6: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(None, few(12)), ("a", few(30, 300)), ("a", few(11)), ("b", None), ("c", " - "), ("d", "One, two! three"), ("e", "one"), ("e2", "ONE"), ("f", few(200, 900)), ("long", few(60))]
    long = items[8][1].split()
    docs = [(1, None), (2, ""), (3, "one"), (4, "x One,TWO;three y"), (None, items[1][1].upper()), (None, items[1][1].upper()), (5, "é ü ß " + items[1][1].replace(" ", "\n--\n")), (5, few(40))]
    docs += [(6, " ".join(long[20:29])), (7, " ".join(long[20:30])), (8, " ".join([*long[20:30], "zz", *long[25:36]])), (9, few(4000)), (10, " ".join(["zz"] * 50)), (11, items[9][1] + " " + items[9][1])]
    return docs, items


def _leaks_brute(docs, items, window=10):
    out = []
    tests = defaultdict(set)
    for item, text in items:
        w = _plain(text)
        for i in range(max(0, len(w) - min(window, len(w)) + 1) if w else 0):
            tests[tuple(w[i : i + min(window, len(w))])].add(item or "")
    sizes = {len(k) for k in tests}
    for i, text in docs:
        w, hit, own = _plain(text), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (key := tuple(w[j : j + k])) in tests:
                    hit |= set(range(j, j + k))
                    own |= tests[key]
        out.append((i, len(w), len(hit), sorted(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("params", [{}, {"shard_bytes": 300}, {"block_words": 150, "piece_words": 16}], ids=["one", "shards", "blocks"])
def test_contamination_brute_force(spark, leaks, params):
    docs, items = leaks
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, hits string, f string").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, off string")
    got = decontaminate.find_contamination(d, b, **params).collect()
    mine = sorted(((r.doc_id, r.n_words, sum(h.end - h.begin for h in r.hits), list(r.items)) for r in got), key=repr)
    assert mine == _leaks_brute(docs, items)
    assert all(list(r.hits) == sorted(r.hits) and all(x.end < y.begin for x, y in zip(r.hits, r.hits[1:])) for r in got)
    clean = decontaminate.decontaminate(d, b, **params)
    assert clean.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted((i, t) for (i, t) in docs if not any(n and i == x[0] and len(_plain(t)) == x[1] for x in mine if (n := x[2])))


def test_longest_matches(spark, leaks):
    docs, items = leaks
    docs, items = [x for x in docs if x[0] is not None and x[0] != 5], [x for x in items if x[0] not in (None, "a")]
    got = decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), shard_bytes=500)
    want = {}
    for item, text in items:
        w = _plain(text)
        for i in range(len(w)):
            best = None
            for d, t in docs:
                x = _plain(t)
                for j in range(len(x)):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    if n >= min(10, len(w)) and (best is None or (-n, d, j) < best):
                        best = (-n, d, j)
            if best:
                want[item, i] = (-best[0], *best[1:])
    assert {(r.item, r.item_start): (r.length, r.doc_id, r.doc_start) for r in got.collect()} == want and want


def test_contamination_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert [tuple(r) for r in decontaminate.find_contamination(some, bench).collect()] == [(1, 2, [], [])]
    assert decontaminate.decontaminate(some, bench).count() == 1
    assert decontaminate.longest_matches(some, bench).count() == 0


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(200):
        text = np.array([rng.randrange(rng.choice([2, 3, 2000000])) for _ in range(rng.randrange(0, 60))] + [0], np.int32)
        tails = {i: text[i : i + int(np.argmin(text[i:] > 0))].tolist() for i in np.flatnonzero(text)}
        got = decontaminate.suffix_array(text, 1 << 20)
        assert [tails[i] for i in got] == sorted(tails.values()) and sorted(got) == sorted(tails)


# runs


def _lyndon(t):
    out = []
    for i in range(len(t)):
        j = i + 1
        while j < len(t) and t[j:] > t[i:]:
            j += 1
        out.append(j - i)
    return out


def _runs(t, least=24, times=3):
    found = []
    for p in range(1, len(t) // times + 1):
        i = 0
        while i + p < len(t):
            j = i
            while j + p < len(t) and t[j] == t[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p) and not any(all(t[x] == t[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                found.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _texts(seed, n=400, longest=70):
    rng = random.Random(seed)
    for _ in range(n):
        t = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(longest))]
        if t and rng.random() < 0.7:
            a, p = rng.randrange(len(t)), rng.randrange(1, 14)
            t = [x if i < a else t[a + (i - a) % min(p, len(t) - a)] for i, x in enumerate(t)]
        yield t


def test_lyndon_arrays():
    for t in _texts(1):
        assert periodic.lyndon_array(t) == _lyndon(t)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (9, 3), (1, 4)])
def test_runs_brute_force(least, times):
    for t in _texts(2):
        want = _runs(t, least, times)
        assert periodic.runs(np.array(t, np.int64), least, times) == want
        # the screen loses none, whatever stands before and after
        words, at = np.array([*t, 7, 7, *t, 8], np.int64), np.array([0, len(t), len(t) + 2, 2 * len(t) + 2, 2 * len(t) + 3])
        got = [(b + s - at[2], n, p) for x, b, e in periodic._stretches(words, at, least, times) if x == 2 for s, n, p in periodic.runs(words[b:e], least, times)]
        assert sorted(got, key=lambda r: (r[0], r[2])) == want


def _op12(rows):
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = _runs(w)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        digest = _sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), _sha(" ".join(x for k, x in enumerate(w) if k not in gone))
        out.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest))
    return sorted(out, key=repr)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(None, "a b " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "go " * 25), (4, "go " * 25), (4, "go " * 23), (5, "a b c\x0bd " * 9 + "x " + "q r " * 20)]
    rows += [(100 + i, " \n".join(f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 300)))) for i in range(150) for k in (2, 40)]
    rows.append((999, " ".join(["p q r s"] * 2000 + [f"w{k}" for k in range(3000)] + ["z"] * 3000)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, n int")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [r for r in rows if r[0] != 999]
    assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id <> 999").collect()), key=repr) == _op12(small)
    runs = [tuple(r) for r in periodic.find_runs(df.where("doc_id = 999")).first().runs]
    assert runs == [(0, 8000, 4), (11000, 3000, 1)]
    assert periodic.find_runs(df.limit(0)).count() == 0


# conversations


def _nodes(convs):
    """Rows of the trie of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], _sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))))) for k, m in members.items()),
        key=repr,
    )


def _talks(rng, n, kinds, longest):
    out = {}
    for c in range(n):
        base = list(out[rng.randrange(c)]) if c and rng.random() < 0.7 else []
        base = base[: rng.randrange(len(base) + 1)]
        out[c * 3 - 20] = out[c] = base + [(rng.choice(["user", "bot", ""]), rng.choice(["é", "", "b", "cc"][:kinds])) for _ in range(rng.randrange(longest))]
    return out


def _rows(spark, convs, rng):
    rows = [(c, k, r or None, t or None, "x", 1) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rows = [(c, None if k == 0 else k, r, t, x, y) for c, k, r, t, x, y in rows] + [(None, 1, "user", "lost", "x", 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, f int").repartition(5)


@pytest.mark.parametrize(("n", "kinds", "longest"), [(40, 4, 6), (60, 2, 25), (0, 1, 1), (1, 1, 1)])
def test_trie_brute_force(spark, n, kinds, longest):
    rng = random.Random(n)
    convs = _talks(rng, n, kinds, longest)
    ids = spark.createDataFrame([(c,) for c in [*convs, *convs, None]], "conv_id long")
    got = trie.conversation_nodes(_rows(spark, convs, rng), ids)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _nodes(convs)


def test_trie_takes_new_batches(spark):
    """A trie that is there grows by further strings to what all make at once."""
    from adfunnel.llm._store import Scratch

    rng = random.Random(8)
    scratch = Scratch(spark, "t")
    convs = {c: t for c, t in _talks(rng, 60, 3, 9).items() if t}
    convs = {min(c for c in convs if convs[c] == t): list(t) for t in map(tuple, convs.values()) for t in [list(t)]}
    names = trie._prefixes(_rows(spark, convs, rng).where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), scratch)
    own = names.withColumnRenamed("conv_id", "id")
    zero = F.lit(0).cast("bigint")
    own = scratch.save(own.unionByName(own.select("id").distinct().select("id", *(zero.alias(c) for c in ("d", "f", "g", "bytes")))), "own")
    strings = own.groupBy("id").agg(F.max("d").alias("n"))
    one = trie.insert(None, own, strings, scratch)
    half = trie.insert(None, own, strings.where("id < 30"), Scratch(spark, "t"))
    two = trie.insert(half, own, strings.where("id >= 30"), Scratch(spark, "t"))
    shape = lambda t: sorted(map(tuple, t.select("f", "g", "len", "up", "hd", "hf", "cf", "pf").collect()))
    assert shape(one) == shape(two) and one.count() > 20


def test_trie_long_conversation_and_copies(spark):
    """One conversation holds most turns, and most conversations are copies of one."""
    long = [("user", str(k % 7)) for k in range(3000)]
    convs = {1: long, 2: long[:2000], 3: long[:1500] + [("bot", "x")]} | {10 + k: [("user", "hi")] for k in range(9000)}
    rows = spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string").repartition(5)
    got = trie.conversation_nodes(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _nodes(convs)


def test_ties_and_repeated_rows(spark):
    rows = [(1, 2, "b", "x"), (1, 2, "a", "y"), (1, 2, "a", "x"), (1, 2, "a", "x"), (1, None, None, None)]
    got = trie.number_turns(spark.createDataFrame([(c, t, r or "", x or "") for c, t, r, x in rows], "conv_id long, turn long, role string, text string"))
    assert [(r.role, r.text) for r in got.orderBy("place").collect()] == [("", ""), ("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")]


# blocks of a list (near-duplicates), columns of line dedup


def test_pairs_across_clusters_of_a_list(spark):
    from adfunnel.llm import minhash

    rng = random.Random(9)
    base = [rng.randrange(50) for _ in range(12)]
    sig = {i: [x if rng.random() < 0.8 else rng.randrange(50) for x in base] for i in range(60)}
    n = {i: rng.choice([10, 11, 30]) for i in sig}
    root = {i: rng.randrange(i // 10 * 10, i + 1) if i % 4 else 0 for i in sig}
    lists = {t: [i for i in sig if rng.random() < (0.9 if t == 0 else 0.1)] for t in range(8)}
    placed = spark.createDataFrame([(t, i, n[i], root[i]) for t, ids in lists.items() for i in ids], "token long, id long, n long, root long")
    sigs = spark.createDataFrame(list(sig.items()), "id long, sig array<int>")
    want = {(a, b) for ids in lists.values() for a in ids for b in ids if a < b and root[a] != root[b] and sum(map(int.__eq__, sig[a], sig[b])) >= 9 and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])}
    assert len(want) > 20
    for block in (4, 256):
        assert {tuple(r) for r in minhash._across(placed, sigs, 9, 80, block).distinct().collect()} == want


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    from adfunnel.llm import lines

    rows = [(1, "a\nb", 7, "x", "y"), (2, "a\nb", 8, "z", "w"), (None, "a\nb", 9, None, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, gone string, c0 string")
    got = lines.dedup_lines(df, min_lines=1, counts=False)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, "", 7, "x", "y"), (2, "", 8, "z", "w"), (None, "a\nb", 9, None, "v")], key=repr)


# pipeline stages


def test_stages_on_clashing_names_repeated_ids_and_empty_tables(spark):
    import corpus_pipeline as p
    from adfunnel.llm import mixing

    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n)) + "."
    rows = [(None if i < 40 else 7 if i < 80 else i, text(60 + i % 90), "a" if i % 3 else None) for i in range(200)] + [(3, text(80), "b")] * 30 + [(None, None, "b"), (4, "", "b")]
    cols = "doc_id long, text string, source string, __id long, __t long, __copies long, __one long, i long, n_lines long, key long, h long"
    docs = spark.createDataFrame([(*r, *range(8)) for r in rows], cols)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
        assert out.select(*cols.replace(" long", "").replace(" string", "").split(", ")[3:]).distinct().collect()[0] == tuple(range(8))
    assert p.encode(spark, docs.limit(0), "").count() == 0
    size = mixing.n_words(F.col("text"))
    got = {r.source: r.n for r in p.mix_sources(spark, docs, "").groupBy("source").agg(F.sum(size).alias("n")).collect()}
    mixed = mixing.mix(docs)
    want = {r.source: (r.n, r.target) for r in mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect()}
    assert all(got[s] == n and abs(n - target) <= 150 for s, (n, target) in want.items())
