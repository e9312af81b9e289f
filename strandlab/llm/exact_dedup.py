"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a run of (digest, best row, copies).  In each round, runs are exchanged so that ``FAN``
neighbouring runs meet, range by range of the digest; a task reads them in order and folds equal digests, keeping the
best identifier and adding up the copies.  A group of any number of copies is one row per run from the first round on,
and the range keeps the work of the last round spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import lookup, unused
from strandlab.session import cut, scratch

#: Runs that meet in one round, and hex digits of the digest that name a range.
FAN, DIGITS = 8, 3
ENTRY = "part int, run long, key string, size long, doc_id long, row long, copies long"


def normalised(text: Column) -> Column:
    """The text without white space (space and controls 9 to 13); null is empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def content_key(text: Column) -> Column:
    """sha-256 of the normalised text, followed by a second hash and the length that verify it."""
    plain = normalised(text)
    return F.concat(F.sha2(plain.cast("binary"), 256), F.hex(F.xxhash64(plain)), F.lit("-"), F.octet_length(plain).cast("string"))


def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge sorted runs: of rows with the same key the first stays, with all their copies.  Keeps one row between batches."""
    last = None
    for batch in batches:
        if last is not None:
            batch = pd.concat([last, batch], ignore_index=True)
        if batch.empty:
            continue
        names = [batch[c].to_numpy() for c in ("part", "run", "key")]
        new = np.ones(len(batch), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in names])
        begin = np.flatnonzero(new)
        out = batch.iloc[begin].reset_index(drop=True)
        out["copies"] = np.add.reduceat(batch["copies"].to_numpy(), begin)
        last = out.iloc[-1:]
        yield out.iloc[:-1]
    if last is not None:
        yield last


def merge_runs(entries: DataFrame, runs: int) -> DataFrame:
    """One row per key: rounds of exchange and merge until all runs are one."""
    while True:
        runs = -(-runs // FAN)
        entries = (
            entries.withColumn("run", F.floor(F.col("run") / FAN).cast("long"))
            .repartition("part", "run")
            .sortWithinPartitions("part", "run", "key", F.desc("size"), F.asc_nulls_last("doc_id"), "row")
            .select(*(c.split()[0] for c in ENTRY.split(", ")))
            .mapInPandas(fold, ENTRY)
        )
        if runs <= 1:
            return entries


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, key, size) of every row of ``docs`` (doc_id, text).

    Of equal texts the row with the most code points stays, then the smallest ``doc_id`` (null last), then the first row
    read: of repeated rows exactly one is kept.  Null text is the empty text, which is equal to a text of white space.
    An empty table gives no row; other columns are not read.
    """
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("key"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size")
        )
    )
    leaf = rows.select(
        F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("int").alias("part"), F.shiftright("row", 33).alias("run"), "key", "size", "doc_id", "row", F.lit(1).cast("long").alias("copies")
    )
    # a run holds a key once: the best row of the partition, by the partial aggregate of the task that reads it
    best = F.max(F.struct("size", F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("order"), (-F.col("row")).alias("first"), "doc_id", "row"))
    first = leaf.withColumn("run", F.floor(F.col("run") / FAN).cast("long")).groupBy("part", "run", "key").agg(best.alias("best"), F.sum("copies").alias("copies"))
    runs = (rows.agg(F.max(F.shiftright("row", 33))).first()[0] or 0) // FAN + 1
    entries = first.select("part", "run", "key", "best.size", "best.doc_id", "best.row", "copies")
    groups = cut(merge_runs(entries, runs).select("key", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "copies"))
    return lookup(rows, groups, "key", "copies").select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.substring("key", 1, 64).alias("text_sha256"), "key", "size"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated under one ``doc_id`` one stays."""
    with scratch() as keep:
        rows = keep(cut(exact_groups(docs).select("doc_id", "key", "size", "kept")))
    keep = rows.filter("kept").select("doc_id", "key", "size")
    twins = cut(rows.groupBy("doc_id", "key", "size").count().filter("count > 1").select("doc_id", "key", "size"))
    key, size, i, k, s = unused(docs, "_key", "_size", "_id", "_k", "_s")
    named = docs.withColumn(key, content_key(F.col("text"))).withColumn(size, F.length(F.coalesce("text", F.lit(""))).cast("long"))

    def semi(table: DataFrame) -> DataFrame:
        t = table.select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("size").alias(s))
        return named.join(t, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k)) & (F.col(size) == F.col(s)), "left_semi")

    on = [keep[c].eqNullSafe(twins[c]) for c in twins.columns]
    single = semi(keep.join(twins, on, "left_anti"))
    repeated = semi(keep.join(twins, on, "left_semi")).dropDuplicates(["doc_id", key, size])
    return single.unionByName(repeated).drop(key, size)
