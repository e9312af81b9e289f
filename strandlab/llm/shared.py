"""Helpers that several operators use: columns, Arrow text buffers, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and the controls 9 to 13.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def crc_fold(column: Column | str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null value is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % folds, F.lit(0))


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of row ranges with at most ``limit`` bytes of text each; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    begin, base = 0, 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield begin, stop
        begin, base = stop, int(ends[stop - 1])


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names with as many underscores in front as ``df`` needs, so that no column of a caller is met."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text each, so that what a task derives stays small."""
    for batch in batches:
        for begin, stop in slices(as_text(batch.column(column)), limit):
            yield batch.slice(begin, stop - begin)


def as_text(column: pa.Array) -> pa.Array:
    """A column of texts with 64-bit offsets from 0 (some kernels misread others); null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    if not len(column) or (offsets[0] == 0 and column.offset == 0):
        return column
    begin, stop = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2].slice(begin, stop - begin) if stop > begin else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets - begin), data)


def gather(offsets: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``rows`` of a ragged array: new offsets and values."""
    begin = offsets[rows]
    size = offsets[rows + 1] - begin
    out = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(size, out=out[1:])
    return out, flat[np.arange(out[-1]) + np.repeat(begin - out[:-1], size)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def byte_runs(texts: pa.Array, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the bytes of ``member`` in texts: all bytes, begin and length of each run, its text, the texts' bounds."""
    column = as_text(texts)
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64))])
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, dtype=np.uint8)
    inside = member[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    border = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    border = border[inside[border] & inside[border - 1]]  # a run that goes on in the next text is two runs
    begin, end = np.sort(np.concatenate([begin, border])), np.sort(np.concatenate([end, border]))
    return data, begin, end - begin, np.searchsorted(bounds, begin, side="right") - 1, bounds


def run_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, stems: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of runs, A-Z as a-z, and of their first bytes for each length of ``stems``."""
    if not len(size):
        return [np.zeros(0, dtype=np.uint64)] * (1 + len(stems))
    first = np.cumsum(size) - size
    nth = np.arange(int(size.sum())) - np.repeat(first, size)
    place = _PLACE[nth & 63]
    far = np.flatnonzero(nth >= 64)
    place[far] = mix64(nth[far].astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    with np.errstate(over="ignore"):
        part = (_FOLD[data[np.repeat(begin, size) + nth]] + np.uint64(1)) * place
        return [mix64(np.add.reduceat(part, first) + size.astype(np.uint64)), *(mix64(np.add.reduceat(np.where(nth < s, part, np.uint64(0)), first) + np.uint64(s)) for s in stems)]


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, hot_rows: int = 20_000, hot_keys: int = 1_000) -> DataFrame:
    """Inner join of many rows with a table that has one row a key and the key's row count in ``weight``.

    Of the keys with over ``hot_rows`` rows, the ``hot_keys`` largest are joined by broadcast (their number is
    the bound), so a key of a third of all rows stays where its rows are; the others meet by a shuffle join.
    """
    hot = table.filter(F.col(weight) > hot_rows).orderBy(F.desc(weight), key).limit(hot_keys)
    marks = F.broadcast(hot.select(F.col(key).alias("_hot")))
    rest = rows.join(marks, rows[key] == F.col("_hot"), "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
