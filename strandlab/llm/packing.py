"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A task encodes its part of the documents and packs groups of a bounded number of tokens, so nothing is shuffled,
no group grows with the input, and a lost task is repeated alone.  In a group, runs of a whole sequence are cut off
first; what is left of each document is a piece with the cost ``linear * n + quadratic * n * n`` (attention stays in
its document).  Pieces go in descending order to the sequence of lowest cost that still has room; pieces that fit
nowhere are cut into the gaps.  The tokens that fill no sequence are cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.encoding import encoder
from strandlab.llm.shared import small_batches

#: Tokens of a group, and the weights of the cost of a piece of n tokens.
GROUP_TOKENS, LINEAR, QUADRATIC = 2_000_000, 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that hold each token of documents of these sizes once.

    >>> place(np.array([3, 2]), 4).tolist()
    [[0, 0, 3, 0, 0], [1, 0, 1, 0, 3], [1, 1, 1, 1, 0]]
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    full = sizes // capacity
    doc = np.repeat(np.arange(len(sizes)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    n = len(doc)
    out = [np.column_stack([doc, nth * capacity, np.full(n, capacity), np.arange(n), np.zeros(n, dtype=np.int64)])]
    rest = sizes - full * capacity
    order = np.flatnonzero(rest)
    order = order[np.argsort(-rest[order], kind="stable")]
    count = int(rest.sum()) // capacity
    room, cost = np.full(count, capacity, dtype=np.int64), np.zeros(count)
    put, waiting = [], []
    for d in order.tolist():
        size = int(rest[d])
        fits = np.where(room >= size, cost, np.inf)
        s = int(np.argmin(fits)) if count else -1
        if s < 0 or fits[s] == np.inf:
            waiting.append((d, int(full[d]) * capacity, size))
            continue
        put.append((d, int(full[d]) * capacity, size, n + s, capacity - int(room[s])))
        room[s] -= size
        cost[s] += linear * size + quadratic * size * size
    gaps = [(n + int(s), capacity - int(room[s]), int(room[s])) for s in np.flatnonzero(room)]
    left = sum(w[2] for w in waiting) - int(room.sum())
    for k, bit in enumerate(b for b in range(capacity.bit_length(), -1, -1) if left >> b & 1):
        gaps.append((n + count + k, 0, 1 << bit))
    gaps.reverse()
    for d, begin, size in waiting:
        while size:
            s, offset, free = gaps.pop()
            part = min(size, free)
            put.append((d, begin, part, s, offset))
            begin, size = begin + part, size - part
            if free > part:
                gaps.append((s, offset + part, free - part))
    return np.concatenate([*out, np.array(put, dtype=np.int64).reshape(-1, 5)])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    Null text is empty (the end id alone); repeated rows and rows of equal or null ``doc_id`` are documents of their
    own; an empty table gives no piece.  A very long document is cut into whole sequences.  Other columns are not read.
    """

    def emit(ids: list, ids_of: list[tuple[np.ndarray, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        sizes = np.concatenate([np.diff(o) for o, _ in ids_of])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([f for _, f in ids_of]).astype("<u4", copy=False).view(np.uint8)
        rows = place(sizes, capacity)
        at = (begin[rows[:, 0]] + rows[:, 1]) * 4
        crc = np.array([zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + rows[:, 2] * 4).tolist())], dtype=np.int64)
        names = pa.concat_arrays(ids).take(pa.array(rows[:, 0]))
        made = [names, *(pa.array(x) for x in (rows[:, 1], rows[:, 2], crc, sizes[rows[:, 0]], base + rows[:, 3], rows[:, 4]))]
        return pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in SCHEMA.split(", ")]), base + int(rows[:, 3].max()) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ids_of, tokens, base = [], [], 0, None
        for batch in small_batches(batches, "text"):
            if base is None:
                base = batch.column("part")[0].as_py() << 40
            offsets, flat = encoder(tokenizer).encode(batch.column("text"))
            flat = np.insert(flat, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            begin = 0
            while begin < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[begin] + group_tokens - tokens, side="right")) - 1
                stop = max(stop, begin + (not tokens))  # groups end at the same rows whatever the batches
                ids.append(batch.column("doc_id").slice(begin, stop - begin))
                ids_of.append((offsets[begin : stop + 1], flat[offsets[begin] : offsets[stop]]))
                tokens += int(offsets[stop] - offsets[begin])
                begin = stop
                if tokens >= group_tokens or begin < batch.num_rows:
                    made, base = emit(ids, ids_of, base)
                    yield made
                    ids, ids_of, tokens = [], [], 0
        if ids:
            yield emit(ids, ids_of, base)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part")).mapInArrow(pack, SCHEMA)
