"""Token counts through a digest cache.

A stored table has a count per (digest of the normalised content, digest of the tokenizer).  Documents are looked up
by digest; only distinct unknown contents are encoded, and their counts are appended.  Texts move once, to the task
that encodes them; digests and counts move otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm.encoding import encoder
from strandlab.llm.shared import lookup
from strandlab.session import cut

CACHE = "content string, version string, n_tokens long"


def version_digest(tokenizer: str) -> str:
    """Digest of the tokenizer file: another file never meets counts of this one."""
    with open(tokenizer, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; new counts are appended to ``cache``.

    The tokenizer sees a text as it is, so normalised content is the text with null as the empty text; equal texts
    are encoded once (once per row where rows repeat under one ``doc_id``).  Repeated rows each get their row.  An empty table appends nothing.  Two writers at once may
    append the same count twice; a count is read once per digest.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("content", F.sha2(F.col("text").cast("binary"), 256))
    keyed = cut(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    contents = cut(keyed.groupBy("content").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")))
    stored = read_cache(spark, cache).filter(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    misses = contents.join(stored, "content", "left_anti").select(F.col("doc_id").alias("_id"), F.col("content").alias("missing"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(encoder(tokenizer).counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([version] * batch.num_rows), counts], names=["content", "version", "n_tokens"])

    # by id first: a content of many copies is fetched once, from the copy with the smallest id
    fetched = rows.join(misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("missing")), "left_semi")
    fetched.select("content", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    known = cut(contents.select("content", "copies").join(counts, "content"))
    return lookup(keyed.select("doc_id", "content", "n_bytes"), known, "content", "copies").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
