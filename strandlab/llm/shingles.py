"""Word shingle sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandlab.llm.shared import byte_runs, mix64, run_hashes

_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the distinct ``width``-word shingles of each text, ascending in each text.

    Words are runs without white space, A-Z lower-cased.  A text of fewer words has its whole sequence as its one
    shingle; a text without words has none.  Two different shingles meet with probability 2**-64.
    """
    data, begin, size, text, _ = byte_runs(texts, _WORD)
    word = run_hashes(data, begin, size)[0]
    factors = mix64(np.arange(101, 101 + width, dtype=np.uint64)) | np.uint64(1)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    count = np.diff(first)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(word), dtype=np.uint64)
        for k in range(width):
            sums[: len(word) - k] += word[k:] * factors[k]
        sums = mix64(sums)
        short = np.flatnonzero((count > 0) & (count < width))
        for t in short.tolist():  # at most width - 1 words each
            own = word[first[t] : first[t + 1]]
            sums[first[t]] = mix64(np.array([(own * factors[: len(own)]).sum() + np.uint64(len(own))], dtype=np.uint64))[0]
    kept = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    sets = [np.unique(sums[a : a + n]) for a, n in zip(first[:-1].tolist(), kept.tolist())]
    return np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
