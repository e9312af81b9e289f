"""Feature rows packed for numpy: written once, read by every round of a training.

A written row is a chunk of about ``CHUNK_VALUES`` numbers, sorted by group; a block is the part of a chunk that one group
owns.  Blocks keep the group's columns, so models are joined to them by Spark; the numbers of a block are one byte string,
dimension after dimension, and null values are a second one that exists only where a value is null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.session import fresh_path

CHUNK_VALUES = 131_072  # numbers of one written row
FILE_CHUNKS = 32  # written rows of one file, which bounds what a reader holds at once
BLOCK = "n int, x binary, gaps binary"


def codes_of(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """One number per row, equal for equal keys (nulls are equal)."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        col = table.column(k).combine_chunks()
        enc = (col.chunk(0) if isinstance(col, pa.ChunkedArray) else col).dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return code


def row_blocks(df: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    """Blocks ``(<by>, n, x, gaps)`` of the rows ``(<by>, x)``, written once."""
    keys, cols = list(by), [f"_x{i}" for i in range(dims)]
    kind = dict(df.dtypes)
    src = df.select(*keys, *[F.col("x")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    fields = ", ".join([*[f"`{k}`: {kind[k]}" for k in keys], "n: int, x: binary, gaps: binary"])
    schema = f"groups array<struct<{fields}>>"
    size = max(256, CHUNK_VALUES // max(1, dims))

    def packed(table: pa.Table) -> pa.RecordBatch:
        code = codes_of(table, keys)
        order = np.argsort(code, kind="stable") if code.any() else np.arange(len(code))
        begin = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        end = np.r_[begin[1:], len(code)]
        held = [table.column(c).to_numpy()[order] for c in cols]
        null = [table.column(c).is_null().to_numpy()[order] for c in cols] if any(table.column(c).null_count for c in cols) else None
        x = [np.stack([v[a:z] for v in held]).astype(float).tobytes() if cols else b"" for a, z in zip(begin, end)]
        gaps = [np.stack([v[a:z] for v in null]).tobytes() if null and any(v[a:z].any() for v in null) else None for a, z in zip(begin, end)]
        heads = [table.column(k).take(pa.array(order[begin])).combine_chunks() for k in keys]
        heads = [h.chunk(0) if isinstance(h, pa.ChunkedArray) else h for h in heads]
        arrays = [*heads, pa.array((end - begin).astype(np.int32)), pa.array(x, pa.binary()), pa.array(gaps, pa.binary())]
        groups = pa.StructArray.from_arrays(arrays, names=[*keys, "n", "x", "gaps"])
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), groups)], names=["groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                rows += held[-1].num_rows
                if rows >= size:
                    yield packed(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield packed(pa.Table.from_batches(held))

    path = fresh_path(df.sparkSession, "blocks")
    src.mapInArrow(run, schema).write.option("maxRecordsPerFile", FILE_CHUNKS).parquet(path)
    written = df.sparkSession.read.schema(schema).parquet(path)
    return written.select(F.explode("groups").alias("_b")).select(*[F.col("_b")[k].alias(k) for k in keys], *[F.col(f"_b.{c}").alias(c) for c in ("n", "x", "gaps")])


def block_values(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Per block the numbers (dims, rows), null as NaN, and which of them are null."""
    for n, x, gaps in zip(batch.column("n").to_pylist(), batch.column("x"), batch.column("gaps")):
        yield (
            np.frombuffer(x.as_buffer(), dtype=float).reshape(dims, n),
            np.frombuffer(gaps.as_buffer(), dtype=bool).reshape(dims, n) if gaps.is_valid else None,
        )
