"""Token ids in ORC files: run-length encoded lists, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their id, so files and the rows in them ascend, and each stripe holds a narrow
range of ids: its row index (minimum and maximum) and Bloom filter tell a reader which stripes can hold a document,
and stripes are read in parallel.  Every row keeps its place among the tokens of its own file; the tokens before a
file are one sum per file, so positions in the whole corpus need no ordered pass over documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.llm.encoding import encoder
from strandlab.llm.shared import small_batches
from strandlab.session import cut

#: Rows of a row-index entry, and the size at which a stripe is written.
INDEX_ROWS, STRIPE_BYTES = 10_000, 16 << 20
FILE_SCHEMA = "doc_id long, file_no int, file_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files in ascending ``doc_id``.

    Null text is empty, its document has the end id alone.  A null ``doc_id`` comes first; rows of the same id stay
    together, by text.  An empty table gives files without rows.  Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = 0
        for batch in small_batches(batches, "text"):
            offsets, flat = encoder(tokenizer).encode(batch.column("text"))
            if end_id is not None:
                flat = np.insert(flat, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            sizes = np.diff(offsets)
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32))).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file_no"), pa.array(tokens + offsets[:-1]), pa.array(sizes), lists],
                names=["doc_id", "file_no", "file_start", "n_tokens", "ids"],
            )
            tokens += int(offsets[-1])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        dealt.select("doc_id", F.spark_partition_id().alias("file_no"), "text")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before.  Filters on ``doc_id`` reach the stripes."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    # one row per file, written: its size is known, so the ids are not shuffled to meet it
    ends = cut(rows.groupBy("file_no").agg(F.sum("n_tokens").alias("file_tokens")))
    before = F.coalesce(F.sum("file_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(ends.select("file_no", before.alias("base")), "file_no").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def ids_crc32(lists: pa.Array) -> np.ndarray:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    flat = np.asarray(lists.flatten(), dtype="<i4").view(np.uint8)
    at = (np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()) * 4
    return np.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])], dtype=np.int64)


def token_digests(read: DataFrame) -> DataFrame:
    """The rows of ``read_token_files`` with the checksum of their ids in place of the ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids_crc32(batch.column("ids")))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
