"""Token ids as flat binary files.

Layout of a folder: for each partition a file of unsigned little-endian ids
(16 bits where the vocabulary fits, else 32), a file of 64-bit document
offsets (one more than documents, in ids) and a file of 64-bit document ids;
and a table ``manifest`` with one row per partition: its files, document and id
counts, and ``base``, the number of ids in all partitions before it. An id's
place in the corpus is base + offset, so every partition is written without
waiting for another.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adfunnel.llm import _words
from adfunnel.llm._bpe import WordCoder

_MANIFEST = "part int, name string, n_docs bigint, n_ids bigint, width int, has_null boolean"


def _open(folder: str):
    """The file system of a folder, and the path in it."""
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else "file://" + folder)
    return at, path


def _local(folder: str) -> bool:
    return "://" not in folder or folder.startswith("file:")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` in ascending id order below ``folder``; returns the manifest with bases.

    A task writes files under a name of its own attempt and the manifest, which
    Spark commits, names those that count: a task that is run again leaves only
    files that nobody reads. Null and empty texts have no ids but the end id.
    Rows with a null id come first, equal ids in the order of their texts. An
    empty table gives an empty manifest.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = WordCoder.of(tokenizer)
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        total, n_docs, nulls = 0, 0, False
        with fs.open_output_stream(f"{path}/{name}.bin") as ids_out, fs.open_output_stream(f"{path}/{name}.off") as off_out, fs.open_output_stream(f"{path}/{name}.doc") as doc_out:
            for batch in batches:
                for piece in _words.chunks(batch, "text", 16 << 20):  # fewer and larger: a slice's words are looked up once
                    ids, at = coder.encode(piece.column("text"))
                    if end_id is not None:
                        ids = np.insert(ids, at[1:], coder.dtype.type(end_id))
                        at = at + np.arange(len(at))
                    ids_out.write(ids.tobytes())
                    off_out.write((at[:-1] + total).astype("<u8").tobytes())
                    keys = piece.column("id")
                    nulls |= bool(keys.null_count)
                    doc_out.write(np.asarray(keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "<i8").tobytes())
                    total += len(ids)
                    n_docs += piece.num_rows
            off_out.write(np.asarray([total], "<u8").tobytes())
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_ids": total, "width": coder.dtype.itemsize, "has_null": nulls}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("has_null", pa.bool_())]))

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/written")
    made = spark.read.schema(_MANIFEST).parquet(f"{folder}/written")
    # one row per file: the prefix sum is a window over the list of files, not over documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST + ", base bigint").parquet(f"{folder}/manifest")


def read_digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files.

    Local files are memory-mapped; elsewhere the file is read. One row of the
    manifest is one unit of work, and a document is a slice of the map.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)

        def load(name: str, dtype: str) -> np.ndarray:
            if _local(folder):
                with pa.memory_map(f"{path}/{name}") as f:
                    return np.frombuffer(f.read_buffer(), dtype)
            with fs.open_input_file(f"{path}/{name}") as f:
                return np.frombuffer(f.read_buffer(), dtype)

        for batch in batches:
            for f in batch.to_pylist():
                ids, off, doc = load(f["name"] + ".bin", f"<u{f['width']}"), load(f["name"] + ".off", "<u8").astype(np.int64), load(f["name"] + ".doc", "<i8")
                for lo in range(0, f["n_docs"], 4096):
                    hi = min(lo + 4096, f["n_docs"])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[lo:hi], off[lo + 1 : hi + 1], strict=True)]
                    keys = doc[lo:hi]
                    gone = (keys == np.iinfo(np.int64).min) if f["has_null"] else None
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=gone), pa.array(f["base"] + off[lo:hi]), pa.array(off[lo + 1 : hi + 1] - off[lo:hi]), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_manifest(spark, folder).repartition(n, "part").mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)
