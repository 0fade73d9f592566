"""The registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.llm import binary, bpe, decontaminate, embed, lines, minhash, mixing, periodic, pii, quality, secrets, substring, trie
from adfunnel.llm._store import Scratch, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s.kind == kind)), F.lit(0)).cast("bigint")
    text = lambda spans: F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","), F.lit(""))
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.KINDS[:3]))
    live = F.coalesce(F.size(F.filter("spans", lambda s: s.live)), F.lit(0)).cast("bigint")
    found = found.withColumn("spans", F.when(F.col("spans").isNotNull(), F.col("spans")).otherwise(F.expr("cast(array() as " + found.schema["spans"].dataType.simpleString() + ")")))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), live.alias("n_live"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokens").path
    binary.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=1)
    return binary.read_digests(spark, folder)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h.end - h.begin)
    n_items = F.size("items").cast("bigint")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the contract's texts for op12; one in ten documents goes on from some word with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    tenth = docs.select("doc_id", "text", (h % 10 == 0).alias("tail"), F.floor((h - h % 10) / 10).alias("g"))
    words = F.when(F.col("tail"), F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    split = tenth.select("*", words.alias("w")).select("*", F.size("w").alias("n"))
    start = split.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    period = start.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    tail = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p) + 1)), 1, n - a)), ' ')")
    return period.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    best = F.expr("get(array_sort(runs, (x, y) -> cast(coalesce(nullif(sign(y.length * x.period - x.length * y.period), 0), nullif(sign(x.start - y.start), 0), sign(x.period - y.period)) as int)), 0)")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    cols = "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period")
    return found.withColumn("best", best).select(*cols, F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations for op13, each beginning with the first turns of an earlier one, and the ids of all, those left without turns too."""
    own = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = trie.number_turns(own)
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    convs = own.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("source"))
    head = placed.where("place < 8").select(F.col("conv_id").alias("source"), "place", "role", "text")
    first = convs.join(head, "source").where("place < h").select("conv_id", "place", "role", "text")
    rest = placed.where(F.col("place") >= h).select("conv_id", "place", "role", "text")
    return first.unionByName(rest).withColumnRenamed("place", "turn"), convs.select("conv_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_nodes(*rebuilt_conversations(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_minhash_near_dedup, op2_embedding_near_dedup, op3_quality_rules, op4_bpe, op5_substring_dedup, op6_pii, op7_secret_scan, op8_token_files, op9_mixing, op10_line_dedup, op11_benchmark_decontamination, op12_periodic_runs, op13_conversation_trie, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express; the others are tested against brute force."""
    from adfunnel.llm import oracle

    return oracle.oracle_sql()
