"""Language identification by multilingual mixture inference.

A document is a mixture of languages; each of its words is emitted by one of them, with the likelihood of its letter
n-grams.  Expectation-maximisation estimates the proportions; the set of languages grows along the estimated order as
long as the likelihood gains more than the penalty for one more proportion.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import as_text, crc_fold, mix64, slices, small_batches
from strandlab.session import cut

#: Hash bins of n-grams (the size of a language's table), expected training rows of a language, added count.
BINS, TRAIN_ROWS, ADDED = 1 << 16, 5_000, 0.1
#: EM rounds, penalty of a language in units of log(words) (1/2 is the Bayesian criterion), characters treated at once.
ROUNDS, PENALTY, CHUNK = 12, 1.0, 100_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark that belongs to one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


@cache
def _pure() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the letter trigrams of all words (one per letter, other characters as borders), the first bin of each
    word, the text of each word, and which texts have a letter."""
    joined = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in joined], dtype=np.int64)
    code = np.frombuffer(("\n".join(joined) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    text = np.repeat(np.arange(len(texts)), sizes)
    has = np.zeros(len(texts), dtype=bool)
    has[text[_pure()[code]]] = True
    c = np.where(letter, code, 0).astype(np.uint64)
    around = np.zeros(len(c) + 2, dtype=np.uint64)
    around[1:-1] = c
    at = np.flatnonzero(letter)
    key = (around[at] << np.uint64(42)) | (around[at + 1] << np.uint64(21)) | around[at + 2]
    bins = (mix64(key) & np.uint64(BINS - 1)).astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return bins, starts, text[at[starts]] if len(starts) else np.zeros(0, dtype=np.int64), has


def fit(docs: DataFrame, training: Column, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their log probabilities of n-gram bins, from rows with ``training`` and a language.

    A language with more rows gives about ``rows`` of them, chosen by a hash of the id.  The tables are one array of
    ``BINS`` numbers a language.  Rows whose text is null or empty teach nothing.
    """
    known = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((BINS, 0), dtype=np.float32)
    share = F.lit(None).cast("double")
    for name in names:
        share = F.when(F.col("lang") == name, min(1.0, rows / counts[name])).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(names), BINS), dtype=np.int64)
        for batch in batches:
            langs = np.array([names.index(x) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                bins, starts, word_text, _ = grams(column.slice(a, b - a).to_pylist())
                lang = np.repeat(langs[a:b][word_text], np.diff(starts, append=len(bins)))
                table += np.bincount(lang * BINS + bins, minlength=table.size).reshape(table.shape)
        lang, at = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(at), pa.array(table[lang, at])], names=["lang", "bin", "n"])

    sums = chosen.mapInArrow(count, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BINS, len(names)), ADDED)
    table[sums["bin"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(weight: np.ndarray, begin: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document and log likelihood, from word likelihoods (words x languages)."""
    count = np.diff(begin, append=len(weight))[:, None]
    for _ in range(rounds):
        part = weight * share[doc]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, begin, axis=0) / count
    return share, np.add.reduceat(np.log(np.maximum((weight * share[doc]).sum(axis=1), 1e-300)), begin)


def mixtures(texts: list[str], table: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of languages of each text (0 outside the chosen set), and which texts have a letter."""
    out = np.zeros((len(texts), table.shape[1]))
    bins, starts, word_text, has = grams(texts)
    if not len(starts) or not table.shape[1]:
        return out, has
    words = np.add.reduceat(table[bins], starts, axis=0).astype(np.float64)
    weight = np.exp(words - words.max(axis=1, keepdims=True))
    begin = np.flatnonzero(np.diff(word_text, prepend=-1))
    rows, count = word_text[begin], np.diff(begin, append=len(word_text))
    doc = np.repeat(np.arange(len(rows)), count)
    langs = table.shape[1]
    full, _ = _em(weight, begin, doc, np.full((len(rows), langs), 1.0 / langs), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    single = np.add.reduceat(np.log(np.maximum(weight, 1e-300)), begin, axis=0)
    alone = np.argmax(single, axis=1)
    best = np.zeros_like(full)
    best[np.arange(len(rows)), alone] = 1.0
    score = single[np.arange(len(rows)), alone]
    active = np.arange(len(rows)) if langs > 1 else np.zeros(0, dtype=np.int64)
    size = 1
    while len(active) and size < langs:
        size += 1
        own = np.isin(doc, active)
        again = np.repeat(np.arange(len(active)), count[active])
        first = np.concatenate([[0], np.cumsum(count[active])[:-1]])
        chosen = order[active][:, :size]
        part = np.take_along_axis(weight[own], chosen[again], axis=1)
        share, value = _em(part, first, again, np.full((len(active), size), 1.0 / size), rounds)
        better = value - score[active] > penalty * np.log(np.maximum(count[active], 2))
        active = active[better]
        score[active] = value[better]
        best[active] = 0.0
        best[active[:, None], chosen[better]] = share[better]
    out[rows] = best
    return out, has


def identify(docs: DataFrame, names: list[str], table: np.ndarray, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, proportions) of every row of ``docs`` (doc_id, text).

    The language with the largest proportion (ties: the first name) and that proportion.  ``und`` and 0 if the text is
    null or has no letter, or if no language was learned.  Repeated rows each get their row.  An empty table gives no
    row.  ``held_out`` is a column of ``docs`` that is passed on; nothing but the text decides.
    """
    model = docs.sparkSession.sparkContext.broadcast(table)  # BINS numbers a language
    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                share, has = mixtures(column.slice(a, b - a).to_pylist(), model.value)
                known = has & (share.sum(axis=1) > 0)
                top = np.argmax(share, axis=1) if len(names) else np.zeros(b - a, dtype=np.int64)
                langs = [[names[i] for i in np.flatnonzero(s)] for s in share]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a),
                        pa.array([names[t] if k else UNKNOWN for t, k in zip(top, known)], pa.string()),
                        pa.array([float(s[t]) if k else 0.0 for s, t, k in zip(share, top, known)], pa.float64()),
                        pa.array(langs, pa.list_(pa.string())), pa.array([s[s > 0].tolist() for s in share], pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(predict, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32 of the id modulo 5 is not 0 and identify every row."""
    held_out = crc_fold("doc_id", 5) == 0
    return identify(docs, *fit(docs, ~held_out), held_out)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which a language was identified, alone or in a mixture of any shares; null, empty and
    letterless texts go.  Without labels all rows stay, and an empty table gives no row.

    Rows are judged by their text alone, so all rows of one id and text share the verdict.
    """
    names, table = fit(docs, crc_fold("doc_id", 5) != 0)
    if not names:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", CHUNK):
            share, has = mixtures(as_text(batch.column("text")).to_pylist(), model.value)
            yield batch.filter(pa.array(has & (share.sum(axis=1) > 0)))

    return docs.mapInArrow(keep, docs.schema)
