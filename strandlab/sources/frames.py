"""Frame tables: one row per (sequence, position) with a feature array."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators.ordering import dense_index
from strandlab.session import cut

TASKS_PER_CORE = 8  # tasks that open the files


def read_frames(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """Delimited numeric text, one frame per line, one file per sequence.

    The files, which may be many and small, are opened once: their lines are written as one table.  A task reads a file
    that is not split from its first line to its last, so the lines are numbered there and meet no shuffle.  Files may be
    split: the order of their lines is (start of the split, running number inside the task), from which dense positions
    are derived.
    """
    lines = _listed(spark, path).select(
        F.col("_metadata.file_path").alias("seq_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
        F.trim("value").alias("line"),
    )
    lines = lines.filter(F.length("line") > 0).withColumn("x", F.split("line", sep).cast("array<double>")).drop("line")
    lines = lines.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    kinds = ", ".join(f"{c} {kind}" for c, kind in lines.dtypes)
    lines = cut(lines.mapInArrow(_numbered, f"{kinds}, t long"))
    whole, split = lines.filter("NOT _split").select("seq_id", "t", "x"), lines.filter("_split").drop("t")
    if split.isEmpty():
        return whole
    return whole.unionByName(dense_index(split, ["seq_id"], ["_block", "_line"]).select("seq_id", "t", "x"))


#: Tasks that list folders; Spark's own value starts 10 000 for as many folders, which takes longer than the listing.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files of a folder, which are listed here by no more tasks than keep the cluster busy."""
    was = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.text(path)
    finally:
        spark.conf.unset(LISTING) if was is None else spark.conf.set(LISTING, was)


def write_lines(rows: DataFrame, key: str, line: str, out: str, tasks: int, order: Sequence[str]) -> None:
    """One text file ``out/key=value/...`` for each value of a whole number, with its lines in order.

    In a shared folder of ``file:`` tasks write the files themselves: Hadoop's local files start a process each for their
    rights, and the driver moves every one.  Other stores get Spark's writer.  Names and lines are the same.
    """
    dealt = rows.repartition(tasks, key).sortWithinPartitions(key, *order).select(key, line)
    at = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(out)
    whole = at.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if whole.getScheme() != "file":
        dealt.write.partitionBy(key).text(out)
        return
    top = whole.getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, made = "", None

        def close() -> None:
            if made is not None:
                made.close()
                os.replace(made.name, f"{os.path.dirname(made.name)}/part-0.txt")  # a task that runs again leaves one whole file

        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if made is None or value != name:
                    close()
                    folder = f"{top}/{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
                    os.makedirs(folder, exist_ok=True)
                    name, made = value, open(f"{folder}/.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="")
                made.write(f"{text or ''}\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["none"])

    os.makedirs(top, exist_ok=True)
    dealt.mapInArrow(write, "none long").write.format("noop").mode("overwrite").save()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their position ``t`` in the run of rows with the same ``seq_id`` and ``_block`` that they belong to."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("seq_id").dictionary_encode()
        code, block = (np.asarray(c, dtype=np.int64) for c in (names.indices, batch.column("_block")))
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        place = np.arange(batch.num_rows)
        begin = np.flatnonzero(new)
        t = place - begin[np.cumsum(new) - 1]
        if (names[0].as_py(), int(block[0])) == last:
            t[: begin[1] if len(begin) > 1 else None] += count
        last, count = (names[-1].as_py(), int(block[-1])), int(t[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t, pa.int64())], names=[*batch.schema.names, "t"])


def as_frames(
    df: DataFrame, seq: str, order: Sequence[str], features: Sequence[str], label: str | None = None
) -> DataFrame:
    """Any ordered table to ``frames(seq_id, t, x[, label])`` with dense positions."""
    cols = [F.col(seq).alias("seq_id"), *[F.col(o) for o in order if o != seq]]
    cols.append(F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    if label:
        cols.append(F.col(label).alias("label"))
    out = dense_index(df.select(*cols), ["seq_id"], [o for o in order if o != seq])
    return out.select("seq_id", "t", "x", *(["label"] if label else []))


def export_flat_vectors(frames: DataFrame, label_map: DataFrame, dims: int) -> DataFrame:
    """One wide row per sequence; sequences with more than one frame are reported.

    ``label_map(label, canonical)`` remaps to the coarser table.  ``single`` is
    false for sequences that break the one-frame rule; they keep null features.
    """
    lengths = frames.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("frames"), F.min("label").alias("label"), F.min_by("x", "t").alias("x")
    )
    mapped = lengths.join(label_map.select("label", "canonical"), "label", "left")
    single = F.col("frames") == 1
    return mapped.select(
        "seq_id",
        F.col("canonical").alias("label"),
        single.alias("single"),
        *[F.when(single, F.col("x")[i]).alias(f"x{i + 1}") for i in range(dims)],
    )
