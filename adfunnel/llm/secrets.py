"""Secret scans judged by how many owners and repositories share a candidate.

Patterns find candidates in every text. A candidate that many owners carry, or
many repositories of few owners, is an example copied from documentation; one
that stays in its place looks live. Only hashes of candidates leave the scan. Counting is two-level and
pre-aggregated, so an example in a third of all documents is a few rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm import _words
from adfunnel.llm._store import Scratch

#: Kinds in their order, base kinds first.
KINDS = ("assign", "access", "hex", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Further candidates: provider prefixes, and long mixed runs of high entropy.
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]{10,}|(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2})")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ENTROPY = 3.5
MIN_OWNERS_OF_EXAMPLE = 3
#: Repositories per owner from which on a candidate of few owners is widely copied too.
MIN_REPOSITORIES_PER_OWNER = 20

# a run of 32 covers 8 places in a row of every fourth character
_SOME_HEX = re.compile(r"[0-9a-f]{7}")
_LONG = re.compile(r"[A-Za-z0-9+/_=.-]{14}")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if _SOME_HEX.search(text[::4]):
        out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(s, e) for _, s, e, _ in out]
    # every match of KEY is a run of 14 or more of its characters
    if _LONG.search(text):
        for m in KEY.finditer(text):
            if entropy(m[0]) >= MIN_ENTROPY and not any(s < m.end() and m.start() < e for s, e in taken):
                out.append(("key", m.start(), m.end(), m[0]))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository: F.Column | None = None) -> DataFrame:
    """(row, id, owner, repository, spans) per row of ``docs``; spans hold the SHA-256 of the value, not the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.chunks(batch, "text"):
                spans = [[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in find(t)] if t else [] for t in part.column("text").to_pylist()]
                cols = [part.column(c) for c in ("row", "id", "owner", "repository")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.list_(_SPAN))], ["row", "id", "owner", "repository", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    repo = F.col(id_col) if repository is None else repository
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repository"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"row bigint, id {kind}, owner string, repository string, spans array<struct<kind:string,start:bigint,end:bigint,hash:string>>")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) over all candidates. A null owner or repository counts as one of its own, apart from the empty string."""
    each = found.select(F.explode("spans").alias("s"), "owner", "repository")
    each = each.groupBy(F.col("s.hash").alias("hash"), "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository: F.Column | None = None, example_owners: int = MIN_OWNERS_OF_EXAMPLE, example_repositories: int = MIN_REPOSITORIES_PER_OWNER) -> DataFrame:
    """(id, spans) per row of ``docs``: each span with kind, start, end, hash, n_owners, n_repositories and live.

    Spans of the base kinds always stay and carry the verdict; a further
    candidate is a span only if it looks live, that is, if fewer than
    ``example_owners`` owners have it, in fewer than ``example_repositories``
    repositories per owner. By default a document is its own
    repository. Null and empty texts have no spans; null and repeated ids and
    repeated rows are rows like any other; other columns are not read. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.save(scan(docs, id_col, text_col, owner_col, repository), "found")
    owners = scratch.save(ownership(found), "owners")
    each = found.where("size(spans) > 0").select("row", F.explode("spans").alias("s")).select("row", "s.*")
    each = each.join(owners, "hash").withColumn("live", (F.col("n_owners") < example_owners) & (F.col("n_repositories") < F.col("n_owners") * example_repositories))
    base = F.col("kind").isin(*KINDS[:3])
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    # a row's spans: as many as its text holds
    spans = each.where(base | F.col("live")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "hash", "n_owners", "n_repositories", "live"))).alias("judged"))
    return found.drop("spans").join(spans, "row", "left").select(F.col("id").alias(id_col), F.col("judged").alias("spans"))
