"""Spherical caps: recall and the number of vectors met, by dimension and number of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adfunnel.llm import embed


def similar(n, dim, cosine, seed=0):
    """Pairs of unit vectors at exactly this cosine (equal ones in one dimension)."""
    rng = np.random.default_rng([seed, dim])
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return a, a
    b = rng.standard_normal((n, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def recall(dim, rows, n):
    a, b = (embed.filters(x, rows) for x in similar(n, dim, 0.9))
    return np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b, strict=True)])


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 5, 6, 7, 8, 12, 15, 16, 32, 64, 256, 1024])
def test_recall_by_dimension(dim):
    for rows in (500, 2000, 40_000):
        assert recall(dim, rows, 400) >= 0.985, rows


@pytest.mark.parametrize("dim", [24, 64, 256])
def test_recall_of_many_rows(dim):
    for rows in (130_000, 4_000_000, 10**9):
        assert recall(dim, rows, 200) >= 0.95, rows


def test_vectors_met_stay_about_constant():
    met = []
    for rows in (2000, 8000, 40_000):
        x = np.random.default_rng(rows).standard_normal((rows, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        name = np.concatenate([embed.filters(p, rows) for p in np.array_split(x, max(1, rows // 1000))])
        assert name.shape[1] == embed.CODES * embed.shape(64, rows)[2]
        _, n = np.unique(name, return_counts=True)
        met.append((n * n).sum() / rows - name.shape[1])
    assert max(met) < 2 * min(met) and max(met) < 200, met


def test_best_directions_are_the_code_s_own():
    """List decoding against a look at every direction."""
    x, _ = similar(50, 12, 0.9)
    turn, books = embed.code(12, 0, 3, 16)
    full = np.stack([np.concatenate([books[0][i], books[1][j], books[2][k]]) for i in range(16) for j in range(16) for k in range(16)])
    want = np.argsort(-(x @ turn) @ full.T, axis=1)[:, :6]
    got = embed.decode(x, 0, 3, 16, 6)
    assert (np.sort(got, axis=1) == np.sort(want, axis=1)).all()


@pytest.mark.parametrize("dim", [2, 3, 5, 20])
def test_links_of_low_dimensions(spark, dim):
    """Links, counts and components against all pairs, some at a cosine just above and below the bound."""
    a, b = similar(60, dim, 0.93, seed=1)
    x = np.concatenate([a, b, a[:5]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    linked = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    np.fill_diagonal(linked, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= linked.sum() and found >= 0.98 * linked.sum()
    label = embed._labels(linked)
    assert sum(got[i].component_id == label[i] for i in range(len(x))) >= 0.95 * len(x)


def clustered(n, dim, seed=0):
    """Random directions, some of them with near copies, in single precision."""
    rng = np.random.default_rng([seed, dim])
    x = rng.standard_normal((n, dim))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(0, 5) if i % 3 else rng.integers(0, n // 2)] + 0.25 * rng.standard_normal(dim)
    return x.astype(np.float32)


def links(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_what_lies_on_disk_stays_near_the_input(spark, monkeypatch):
    """A vector isn't written once a filter: neither to intermediate tables nor, pass by pass, to be dealt out."""
    import os

    x = clustered(3000, 64)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    most, held, save, drop = [0], {}, embed.Scratch.save, embed.Scratch.drop

    def saved(self, df, name):
        out = save(self, df, name)
        held[name] = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{self.path}/{name}".removeprefix("file://")) for f in files)
        most[0] = max(most[0], sum(held.values()))
        return out

    def dropped(self, *names):
        drop(self, *names)
        for name in names:
            held.pop(name)

    monkeypatch.setattr(embed.Scratch, "save", saved)
    monkeypatch.setattr(embed.Scratch, "drop", dropped)
    got = links(embed.near_vectors(vectors))
    assert most[0] < 3 * x.nbytes, most[0] / x.nbytes
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = y @ y.T >= 0.9
    assert sum(n for n, _, _ in got.values()) >= 0.99 * (linked.sum() - len(x))
    assert all(got[i][0] <= linked[i].sum() - 1 for i in range(len(x)))


def test_passes_deal_out_a_bounded_share(spark, monkeypatch):
    """Parts of the cells in turn: the same links, and no pass deals out much more than it may."""
    x = clustered(1200, 64, seed=1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0] * 3), (5001, [1.0, 1.0, 1.1])], "vec_id long, embedding array<float>")
    want = links(embed.near_vectors(vectors))
    dealt, verify = [], embed._verify
    most = 3 * (x.nbytes + 48 * len(x))

    def measured(df, *args):
        dealt.append(df.selectExpr("coalesce(sum(length(x) + length(own) + 48), 0)").first()[0])
        return verify(df, *args)

    monkeypatch.setattr(embed, "_verify", measured)
    monkeypatch.setattr(embed, "PASS_BYTES", 1)
    assert links(embed.near_vectors(vectors)) == want
    assert len(dealt) > embed.CODES and 0 < max(dealt) < 1.5 * most, (dealt, most)


def test_cells_cut_into_blocks_give_the_same_links(spark, monkeypatch):
    """Units of work of pairs of blocks, and filters listed or multiplied out, against one unit a cell."""
    for dim in (4, 64):
        x = clustered(600, dim, seed=2)
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        want = links(embed.near_vectors(vectors))
        with monkeypatch.context() as m:
            m.setattr(embed, "_count", lambda *a, count=embed._count: count(*a).withColumn("blocks", F.lit(3)))
            assert links(embed.near_vectors(vectors, block_rows=40)) == want


def test_cells_hold_all_filters_of_a_vector_and_few_copies():
    """The cells of a row are ranges that hold each of its filters once; there are fewer of them than filters."""
    for dim, rows in ((3, 1000), (20, 1000), (64, 1000), (64, 51_282), (64, 10**7)):
        x, _ = similar(200, dim, 0.9)
        name = embed.filters(x, rows)
        assert (np.diff(name, axis=1) > 0).all()
        row, seed, cell, begin, end = embed.runs(name, dim, rows)
        assert (end > begin).all() and (end - begin).sum() == name.size
        assert len(set(zip(row.tolist(), cell.tolist(), strict=True))) == len(row)
        directions, width, _ = embed.cells(dim, rows)
        first, last = name[row, begin] - seed * directions, name[row, end - 1] - seed * directions
        assert (first >= 0).all() and (last < directions).all() and (first // width == last // width).all()
        if dim >= embed.LOW_DIM:
            assert len(row) < 0.7 * name.size


def test_known_words_are_kept_while_they_fit():
    """Words of a slice that are known already take no further place, so they don't empty the memory."""
    import public_tokenizers
    import pyarrow as pa

    from adfunnel.llm._bpe import WordCoder

    coder = WordCoder(public_tokenizers.path("word_bpe_49k.json"), most_words=6)
    learned = []
    learn = coder._learn
    coder._learn = lambda words: learned.append(words) or learn(words)
    texts = pa.array(["one two three four", None, "four, three <|endoftext|> one"])
    for slice_ in (texts[:1], texts[:1]):
        coder.encode(slice_)
    assert learned == [["one", "two", "three", "four"]]
    ids, at = coder.encode(texts)
    for text, a, b in zip(texts.to_pylist(), at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == coder.tok.encode(text or "", add_special_tokens=False).ids


def test_words_are_learned_without_their_tails_and_as_the_library_codes_them():
    """A word's tail takes no place of its own per word; odd letters, added tokens and empty memories give the library's ids."""
    import random

    import public_tokenizers
    import pyarrow as pa

    from adfunnel.llm._bpe import WordCoder

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = WordCoder(path, most_words=1000)
    learned = []
    learn = coder._learn
    coder._learn = lambda words: learned.extend(words) or learn(words)
    coder.encode(pa.array(["lorem, ipsum!! lorem. lorem### ipsum"]))
    assert sorted(learned) == ["!!", "###", ",", ".", "ipsum", "lorem"]

    words = "lorem lorem, ipsum!! Ipsum### don't don't. we'll, é é. Été!! İx ßa ﬁn a1. 1. ... ## x## a.b, ,a e\u0301, \u0301 中文 中文. ª ǅ a\u00a0b <|endoftext|> a<|endoftext|>. <|ENDOFTEXT|>, <|end a< ⅷ. 𝔘𝔫 ʰ ᾳ.".split(" ")
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(400)] + [None, "", " \n"]
    for coder in (WordCoder(path, most_words=1000), WordCoder(path, most_words=3)):
        for i in range(0, len(texts), 50):
            some = texts[i : i + 50]
            ids, at = coder.encode(pa.array(some, pa.string()))
            for text, a, b in zip(some, at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == coder.tok.encode(text or "", add_special_tokens=False).ids, text
    # with a tokenizer that ends no word by a mark, and where an added token holds a tail
    plain = WordCoder(path, most_words=1000)
    plain.ends, plain.tail = None, ""
    ids, at = plain.encode(pa.array(texts[:50], pa.string()))
    assert ids.tolist() == [i for t in texts[:50] for i in plain.tok.encode(t, add_special_tokens=False).ids]
