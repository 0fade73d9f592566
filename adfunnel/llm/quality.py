"""Quality rules by weak supervision (DataFrame functions only).

Every rule votes good (1) or bad (-1) on a document, or abstains (0). No rule
is trusted by itself: expectation-maximisation over the vote patterns of all
documents estimates how each rule votes on good and on bad documents, and the
posterior probability of "good" decides. The patterns are counted in Spark;
there are at most 3 ** rules of them, whatever the corpus, and the estimation
runs on these counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm._store import Scratch

ROUNDS = 25
MIN_POSTERIOR = 0.5

#: Each rule: name, condition of a bad vote, condition of a good vote (neither: abstain). Integer arithmetic, the
#: same in every SQL, over the features below. Rules that look for one fault abstain where they don't find it:
#: its absence says little. Repeated lines that "repeats" sees don't count a second time.
RULES = [
    ("symbols", "n_symbols * 20 > n_words", "false"),
    ("plain", "(n_symbols + n_exclaims) * 100 > word_chars", "(n_symbols + n_exclaims) * 200 <= n_words"),
    ("repeats", "n_repeat_words * 4 > n_words", "false"),
    ("lines", "n_dup_lines * 10 > n_lines * 3 and n_repeat_words * 4 <= n_words", "false"),
    ("capitals", "n_upper * 3 > word_chars", "false"),
    ("exclaims", "n_exclaims * 10 > n_words", "false"),
    ("digits", "n_digits * 3 > word_chars", "false"),
    ("word_length", "word_chars > n_words * 10 or word_chars < n_words * 3", "word_chars >= n_words * 4 and word_chars <= n_words * 6"),
    ("sentences", "n_ends * 2 > n_words or (n_ends * 100 < n_words and n_words >= 50)", "n_ends * 50 >= n_words and n_ends * 3 <= n_words"),
]

_SPACE = " \t\n\x0b\x0c\r"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``extra`` columns, the base counts and those that rules use; all long.

    n_repeat_words counts the words in 3-word windows that a text holds twice
    or more. Windows are compared by a 64-bit hash, sorted within the row, so
    no row leaves its partition. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(F.col("t"), F.lit(_SPACE))
    carried = [f"x_{c}" for c in extra or []]
    d = docs.select(F.col(id_col).alias("id"), text.alias("t"), *[F.col(c).alias(x) for c, x in zip(extra or [], carried, strict=True)])
    d = d.withColumn("words", F.when(F.length(trimmed) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    count = lambda chars: (F.length("t") - F.length(F.translate("t", chars, ""))).cast("bigint")
    d = d.select(
        "id",
        *carried,
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("t", _SPACE, "")).cast("bigint").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        lines.alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "\\p{Lu}+", ""))).cast("bigint").alias("n_upper"),
        count("!").alias("n_exclaims"),
        count("0123456789").alias("n_digits"),
        F.size(F.filter("words", lambda w: F.right(w, F.lit(1)).isin(".", "!", "?"))).cast("bigint").alias("n_ends"),
    )
    d = d.withColumn("hs", F.expr("case when n_words < 4 then cast(array() as array<bigint>) else transform(sequence(0, int(n_words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) end"))
    d = d.select(
        *[c for c in d.columns if c not in ("words", "lines")],
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        # (hash, place) in order, only where some window repeats
        F.expr("case when size(array_distinct(hs)) < size(hs) then sort_array(transform(hs, (h, i) -> struct(h as h, i as i))) end").alias("s"),
    )
    # places of windows with an equal neighbour in that order
    d = d.withColumn("p", F.expr("sort_array(filter(transform(s, (x, k) -> if((k > 0 and s[k - 1].h = x.h) or (k + 1 < size(s) and s[k + 1].h = x.h), x.i, -1)), i -> i >= 0))"))
    # each such window covers 3 words, or as many as lie before the next one
    covered = F.expr("case when p is null or size(p) = 0 then 0L else aggregate(transform(p, (x, k) -> if(k = 0, 3, least(3, x - p[k - 1]))), 0L, (a, x) -> a + x) end")
    keep = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_exclaims", "n_digits", "n_ends"]
    return d.select(F.col("id").alias(id_col), *[F.col(x).alias(x[2:]) for x in carried], *keep, covered.alias("n_repeat_words"))


def votes(feats: DataFrame, rules: list = RULES) -> DataFrame:
    """The votes, one column v_<rule> each."""
    return feats.select("*", *[F.expr(f"case when n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end").alias(f"v_{name}") for name, bad, good in rules])


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of "good", and per rule the log-likelihood ratio of each vote, by EM over (votes, count) rows.

    The start is the share of good votes among those cast. Counts are smoothed,
    so a vote never seen with a class keeps a chance. A document on which
    every rule abstains has the prior odds.
    """
    m = len(patterns[0][0]) if patterns else 0
    patterns = sorted(patterns)
    post = [(1.0 + sum(v > 0 for v in vs)) / (2.0 + sum(v != 0 for v in vs)) for vs, _ in patterns]
    prior, llr = 0.0, []
    for _ in range(rounds):
        good = sum(n * q for (_, n), q in zip(patterns, post, strict=True))
        bad = sum(n * (1.0 - q) for (_, n), q in zip(patterns, post, strict=True))
        prior = math.log((good + 1.0) / (bad + 1.0))
        llr = []
        for j in range(m):
            row = {}
            for v in (-1, 0, 1):
                g = sum(n * q for (vs, n), q in zip(patterns, post, strict=True) if vs[j] == v)
                b = sum(n * (1.0 - q) for (vs, n), q in zip(patterns, post, strict=True) if vs[j] == v)
                row[v] = math.log((g + 1.0) / (good + 3.0)) - math.log((b + 1.0) / (bad + 3.0))
            llr.append(row)
        post = [1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, prior + sum(r[v] for r, v in zip(llr, vs, strict=True)))))) for vs, _ in patterns]
    return prior, llr


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list | None = None, rules: list = RULES, rounds: int = ROUNDS, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Features, posterior and verdict per row of ``docs``.

    base_failed: under 50 words, or more than half of the words in repeated
    windows. kept: not base_failed and posterior >= ``min_posterior``. Null and
    empty texts fail the base. Null and repeated ids are rows like any other;
    other columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    # read again for the verdict: small numbers instead of the texts
    feats = scratch.save(votes(features(docs, id_col, text_col, extra), rules), "votes")
    cols = [f"v_{name}" for name, _, _ in rules]
    # at most 3 ** len(rules) rows
    patterns = [(tuple(r[:-1]), r[-1]) for r in feats.groupBy(*cols).count().collect()]
    prior, llr = estimate(patterns, rounds)
    odds = F.lit(float(prior))
    for c, row in zip(cols, llr, strict=True) if llr else ():
        odds = odds + F.when(F.col(c) == -1, F.lit(row[-1])).when(F.col(c) == 0, F.lit(row[0])).otherwise(F.lit(row[1]))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = feats.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))
