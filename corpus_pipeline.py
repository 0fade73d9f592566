"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads;
all but the last return the columns of ``docs``. ``run`` writes each stage's
result as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.llm import bpe, lines, minhash, mixing, quality
from adfunnel.llm._store import Scratch, table
from adfunnel.llm.queries import tokenizer_path


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, in any case."""
    return name + "_" * max(map(len, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go (by id and text, so rows that share both go or stay together).

    Null ids are ids like any other; a null or empty text has no words and goes. Other columns keep their names whatever they are; an empty table stays empty.
    """
    bad = quality.judge(docs.select("doc_id", "text", F.xxhash64("text").alias("t")), extra=["t"]).where(~F.col("kept")).select("doc_id", "t").distinct()
    i, t = _fresh(docs, "i"), _fresh(docs, "t")
    bad = bad.select(F.col("doc_id").alias(i), F.col("t").alias(t))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t)), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines, runs of one line included, go from the texts; every row stays, and n_chars follows the text.

    Nulls, empty and repeated rows and clashing names as in ``lines.dedup_lines``.
    """
    out = lines.dedup_lines(docs, min_lines=1, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Rows that share an id are one document and stay or go together; rows without an id, and texts without words, link with nothing and stay. Other columns keep their names whatever they are; an empty table stays empty.
    """
    i = _fresh(docs, "i")
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(i)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(i), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; nulls, repeated rows and clashing names as in ``mixing.mix`` and ``mixing.repeat_rows``."""
    return mixing.repeat_rows(docs, mixing.mix(docs, keyed=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests per document of the mix; nulls and repeated rows as in ``bpe.encode_documents``."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: Signatures, the mix's draws and the encoding are beyond SQL; a test compares ids, texts and digests after each stage with SQL, plain Python and the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
