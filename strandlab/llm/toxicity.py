"""Toxic spans by a linear-chain conditional random field.

Documents carry one label each, the field needs labelled tokens: a token of a toxic document is tagged toxic if its
word is, by a significance test over the labelled documents, typical of toxic ones; every other token is tagged clean.
Weights of hashed word features, of the tags and of the tag transitions maximise the conditional likelihood by gradient
steps over all chosen documents, one Spark job a step.  Forward-backward marginals of the toxic tag give the offending
spans; their sum of log odds, calibrated on the learning documents, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import as_text, byte_runs, crc_fold, mix64, run_hashes, slices
from strandlab.session import cut

#: Hash bins of features, expected learning documents of each label, gradient steps and their size, weight decay.
BINS, TRAIN_ROWS, STEPS, RATE, DECAY = 1 << 18, 4_000, 25, 1.0, 1e-6
#: Likelihood ratio and odds by which a feature is typical of toxic documents.
RATIO, ODDS = 24.0, 8.0
#: Marginal from which a token belongs to a span; score from which a document is toxic; bytes treated at once.
SPAN, TOXIC, CHUNK = 0.5, 0.7, 4_000_000
#: Features of a token: the word and its first bytes.  Tokens that one step of the recursion treats in a row.  Tasks of a
#: sum, numbers that one row of it holds.
STEMS, LANE, TASKS, SLICE = (4, 5), 64, 8, 1 << 15
FEATURES = 1 + len(STEMS)

_WORD = np.zeros(256, dtype=bool)  # ASCII letters and digits, and all bytes beyond ASCII
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of ASCII letters and digits and of all other bytes beyond ASCII, A-Z lower-cased) of texts:
    the hashes of their features (tokens x FEATURES), begin and length in bytes within their text, and text."""
    data, begin, size, text, bounds = byte_runs(texts, _WORD)
    return np.column_stack(run_hashes(data, begin, size, STEMS)), begin - bounds[text], size, text


def feature_bins(hashes: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """Bins of features.  A bin of a typical feature (hashes, ascending) belongs to it alone: others that fall there go to
    bin 0, so that no word is taken for a toxic one because it shares a bin."""
    bins = (hashes & np.uint64(BINS - 1)).astype(np.int32)
    own = np.zeros(BINS, dtype=bool)
    own[(typical & np.uint64(BINS - 1)).astype(np.int64)] = True
    at = np.nonzero(own[bins])
    met = hashes[at]
    if len(met):
        right = typical[np.minimum(np.searchsorted(typical, met), len(typical) - 1)] == met
        bins[at[0][~right], at[1][~right]] = 0
    return bins


def marginals(odds: np.ndarray, text: np.ndarray, move: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward of two tags (clean, toxic) over all texts at once.

    ``odds`` is the score of the toxic tag of each token, ``move[i, j]`` of a step from tag i to tag j, ``first`` of
    the toxic tag at a text's first token.  Gives the marginal of the toxic tag and the expected steps (token x 4, zero
    at a first token).  Texts are cut into lanes of ``LANE`` tokens that are treated side by side; a lane is a 2 x 2
    matrix, and lanes of a text are joined by doubling, so a very long text takes few more rounds.
    """
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    new = np.diff(text, prepend=-1) != 0
    start = np.flatnonzero(new)
    at = np.arange(n) - np.repeat(start, np.diff(start, append=n))
    lane = np.cumsum(new | (at % LANE == 0)) - 1
    place = at % LANE
    lanes = int(lane[-1]) + 1
    owner = text[np.flatnonzero(place == 0)]
    steps = np.zeros((LANE, 2, 2, lanes))
    steps[:, 0, 0], steps[:, 1, 1] = 1.0, 1.0  # places without a token change nothing
    toxic = np.exp(np.clip(odds, -30, 30))
    step = np.exp(np.clip(move, -30, 30))
    for i in (0, 1):
        steps[place, i, 0, lane] = np.where(new, 1.0, step[i, 0])
        steps[place, i, 1, lane] = np.where(new, np.exp(min(30.0, max(-30.0, first))), step[i, 1]) * toxic
    whole = steps[0].copy()
    for t in range(1, LANE):
        whole = _times(whole, steps[t])
    before, after = _joined(whole, owner), _suffix(whole, owner)
    enter = np.ones((2, lanes))
    inner = np.flatnonzero(np.diff(owner, prepend=-1) == 0)
    enter[:, inner] = before[0][:, inner - 1]
    leave = np.ones((2, lanes))
    follows = np.flatnonzero(np.append(np.diff(owner) == 0, False))
    leave[:, follows] = after[:, :, follows + 1].sum(axis=1)
    forward = np.empty((LANE + 1, 2, lanes))
    forward[0] = enter / enter.max(axis=0)
    for t in range(LANE):
        f = np.stack([forward[t, 0] * steps[t, 0, j] + forward[t, 1] * steps[t, 1, j] for j in (0, 1)])
        forward[t + 1] = f / f.max(axis=0)
    backward = np.empty((LANE + 1, 2, lanes))
    backward[LANE] = leave / leave.max(axis=0)
    for t in reversed(range(LANE)):
        b = np.stack([steps[t, i, 0] * backward[t + 1, 0] + steps[t, i, 1] * backward[t + 1, 1] for i in (0, 1)])
        backward[t] = b / b.max(axis=0)
    pair = forward[:-1, :, None, :] * steps * backward[1:, None, :, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    own = pair[place, :, :, lane].reshape(n, 4)
    marginal = own[:, 1] + own[:, 3]
    own[new] = 0.0
    return marginal, own


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, place by place, each scaled to a largest entry of 1."""
    out = np.stack([np.stack([a[i, 0] * b[0, j] + a[i, 1] * b[1, j] for j in (0, 1)]) for i in (0, 1)])
    return out / out.max(axis=(0, 1))


def _joined(whole: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Product of a text's lanes up to each lane, by doubling."""
    out, reach, longest = whole.copy(), 1, int(np.bincount(owner).max())
    while reach < longest:
        at = np.flatnonzero(owner[reach:] == owner[:-reach]) + reach
        out[:, :, at] = _times(out[:, :, at - reach], out[:, :, at])
        reach *= 2
    return out


def _suffix(whole: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Product of a text's lanes from each lane on: the same from the end, with the factors turned."""
    turned = _joined(whole.swapaxes(0, 1)[:, :, ::-1], owner[::-1])
    return turned[:, :, ::-1].swapaxes(0, 1)


def learning_rows(docs: DataFrame, labels: DataFrame, learning: Column, rows: int) -> DataFrame:
    """(toxic, features) of labelled documents that may teach: about ``rows`` of each label, chosen by a hash of the id.

    Of several labels of a document the largest counts; a null label teaches nothing.
    """
    named = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(learning)
    counts = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for value in (0, 1):
        share = F.when(F.col("toxic") == value, min(1.0, rows / counts.get(value, 1))).otherwise(share)
    chosen = cut(named.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < share * 1_000_003))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                hashes, _, _, text = tokens(column.slice(a, b - a))
                ends = np.searchsorted(text, np.arange(b - a + 1))
                packed = [hashes[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), pa.array(packed, pa.binary())], names=["toxic", "features"])

    taught = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen.hint("shuffle_hash"), "doc_id")
    return cut(taught.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(features, "toxic int, features binary"))


def _summed(taught: DataFrame, work, width: int) -> np.ndarray:
    """Sum over at most ``TASKS`` tasks of the array of ``width`` numbers that ``work`` makes of a task's rows.

    Tasks hand on slices of ``SLICE`` numbers; those of one place meet in one task and are added up in the order of the
    first tasks, so that the driver gets one array, however many tasks there are, and reruns agree.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            flags = np.asarray(batch.column("toxic"), dtype=np.int64)
            packed = batch.column("features").to_pylist()
            hashes = np.frombuffer(b"".join(packed), dtype=np.uint64).reshape(-1, FEATURES)
            total += work(hashes, np.repeat(np.arange(len(flags)), [len(p) // (8 * FEATURES) for p in packed]), flags)
        begin = range(0, width, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(begin, pa.int64()), pa.array([total[i : i + SLICE].tobytes() for i in begin], pa.binary())], names=["begin", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for begin, numbers in zip(batch.column("begin").to_pylist(), batch.column("sums")):
                found = np.frombuffer(numbers.as_buffer())
                sums[begin] = sums[begin] + found if begin in sums else found.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["begin", "sums"])

    parts = taught.coalesce(TASKS).mapInArrow(part, "begin long, sums binary").withColumn("task", F.spark_partition_id())
    met = parts.repartition("begin").sortWithinPartitions("begin", "task").select("begin", "sums").coalesce(TASKS).mapInArrow(add, "begin long, sums binary")
    out = np.zeros(width)
    for row in met.collect():
        out[row["begin"] : row["begin"] + SLICE] = np.frombuffer(row["sums"])
    return out


def fit(docs: DataFrame, labels: DataFrame, learning: Column, rows: int = TRAIN_ROWS, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights of the field and of the score.  Bounds: ``rows`` documents of a label, ``BINS`` weights.

    Without toxic or without clean learning documents the field finds nothing and every score is the share of toxic
    ones (near 0 without any).
    """
    taught = learning_rows(docs, labels, learning, rows)

    def frequency(hashes: np.ndarray, text: np.ndarray, flags: np.ndarray) -> np.ndarray:
        pairs = np.unique((text[:, None].astype(np.int64) * BINS + feature_bins(hashes, none)).reshape(-1))
        return np.concatenate([np.bincount(flags[pairs // BINS] * BINS + pairs % BINS, minlength=2 * BINS), np.bincount(flags, minlength=2)])

    none = np.zeros(0, dtype=np.uint64)
    counted = _summed(taught, frequency, 2 * BINS + 2)
    clean, toxic, (cleans, toxics) = counted[:BINS], counted[BINS : 2 * BINS], counted[2 * BINS :]
    rate = toxics / max(1.0, cleans + toxics)
    model = {"weight": np.zeros(BINS), "move": np.zeros((2, 2)), "first": -20.0, "bias": -20.0, "typical": none, "line": np.array([np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)), 0.0])}
    if not cleans or not toxics:
        return model
    typical = _typical_features(taught, _typical(clean, toxic, cleans, toxics))
    scores = np.zeros(BINS + 6)  # weights of bins, bias of the toxic tag, first tag, four steps
    square = np.zeros(BINS + 6)

    marked = np.zeros(BINS, dtype=bool)
    marked[(typical & np.uint64(BINS - 1)).astype(np.int64)] = True

    def gradient(scores: np.ndarray, hashes: np.ndarray, text: np.ndarray, flags: np.ndarray) -> np.ndarray:
        out, bins = np.zeros(BINS + 6), feature_bins(hashes, typical)
        tag = (marked[bins].any(axis=1) & (flags[text] == 1)).astype(np.float64)
        toxic_at, pair = marginals(scores[bins].sum(axis=1) + scores[BINS], text, scores[BINS + 2 :].reshape(2, 2), scores[BINS + 1])
        miss = tag - toxic_at
        new = np.diff(text, prepend=-1) != 0
        out[:BINS] = np.bincount(bins.reshape(-1), np.repeat(miss, FEATURES), minlength=BINS)
        out[BINS], out[BINS + 1] = miss.sum(), miss[new].sum()
        inner = np.flatnonzero(~new)
        out[BINS + 2 :] = np.bincount((2 * tag[inner - 1] + tag[inner]).astype(np.int64), minlength=4) - pair.sum(axis=0)
        return out

    for _ in range(steps):
        sent = taught.sparkSession.sparkContext.broadcast(scores)
        slope = _summed(taught, lambda *rows, sent=sent: gradient(sent.value, *rows), BINS + 6) - DECAY * (cleans + toxics) * scores
        sent.destroy()  # else the weights of every step stay with the driver until it collects its garbage
        square += slope * slope
        scores = scores + RATE * slope / np.maximum(np.sqrt(square), 1e-9)
    model |= {"typical": typical, "weight": scores[:BINS], "bias": scores[BINS], "first": scores[BINS + 1], "move": scores[BINS + 2 :].reshape(2, 2)}

    def histogram(hashes: np.ndarray, text: np.ndarray, flags: np.ndarray) -> np.ndarray:
        value, _ = strength(hashes, text, len(flags), model)
        return np.bincount(flags * 64 + np.minimum(63, np.floor(8 * np.log1p(value))).astype(np.int64), minlength=128)

    model["line"] = _calibrate(_summed(taught, histogram, 128).reshape(2, 64), cleans, toxics)
    return model


def _typical_features(taught: DataFrame, bins: np.ndarray) -> np.ndarray:
    """Hashes, ascending, of the features in typical bins that are typical themselves.  Typical bins are few, and so are
    the features counted here: at most what the learning documents have in them.

    Documents with the same smallest three-word shingle, as copies and most near copies have, count once: else every
    word of a toxic document with a few copies would look typical.
    """

    def source(words: np.ndarray) -> int:
        with np.errstate(over="ignore"):
            three = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7) if len(words) > 2 else words
        return int(mix64(three).min().view(np.int64)) if len(three) else 0

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [source(np.frombuffer(p, dtype=np.uint64)[::FEATURES]) for p in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.int64())], names=["toxic", "source"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, flags = batch.column("features").to_pylist(), np.asarray(batch.column("toxic"), dtype=np.int64)
            parts = [np.unique(h[bins[(h & np.uint64(BINS - 1)).astype(np.int64)]]) for h in (np.frombuffer(p, dtype=np.uint64) for p in packed)]
            hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            own = np.array([source(np.frombuffer(p, dtype=np.uint64)[::FEATURES]) for p in packed], dtype=np.int64)
            size = [len(p) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.repeat(flags, size)), pa.array(np.repeat(own, size))], names=["h", "toxic", "source"])

    totals = {r["toxic"]: r["count"] for r in taught.mapInArrow(sources, "toxic int, source long").distinct().groupBy("toxic").count().collect()}
    cleans, toxics = totals.get(0, 0), totals.get(1, 0)
    seen = taught.mapInArrow(count, "h long, toxic long, source long").distinct()
    found = seen.groupBy("h").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).filter("toxic > 1").toPandas()
    keep = _typical(found["clean"].to_numpy(float), found["toxic"].to_numpy(float), cleans, toxics)
    return np.sort(found["h"].to_numpy(np.int64)[keep].view(np.uint64))


def _typical(clean: np.ndarray, toxic: np.ndarray, cleans: float, toxics: float) -> np.ndarray:
    """Features that far more toxic than clean documents show: by odds, and by the likelihood ratio of one rate or two."""
    p, q = (toxic + 0.5) / (toxics + 1), (clean + 0.5) / (cleans + 1)
    seen, rate = toxic + clean, toxics / (toxics + cleans)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (seen * rate)), 0) + np.where(clean > 0, clean * np.log(clean / (seen * (1 - rate))), 0))
    return (p / (1 - p) > ODDS * q / (1 - q)) & (ratio > RATIO)


def _calibrate(seen: np.ndarray, cleans: float, toxics: float) -> np.ndarray:
    """Intercept and slope of the logistic line from log(1 + strength) to the label, from a histogram of both labels."""
    x, line = (np.arange(64) + 0.5) / 8, np.array([np.log(toxics / cleans), 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(line[0] + line[1] * x, -30, 30)))
        slope = np.array([(seen[1] - seen.sum(axis=0) * p).sum(), ((seen[1] - seen.sum(axis=0) * p) * x).sum()]) - 1e-3 * line
        w = seen.sum(axis=0) * p * (1 - p)
        curve = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        move = np.linalg.solve(curve, slope)
        line = line + np.clip(move, -1, 1)
    return line


def strength(hashes: np.ndarray, text: np.ndarray, texts: int, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Toxic evidence of each text (sum of -log(1 - marginal) over its tokens), and the marginals."""
    toxic, _ = marginals(model["weight"][feature_bins(hashes, model["typical"])].sum(axis=1) + model["bias"], text, model["move"], float(model["first"]))
    return np.bincount(text, -np.log1p(-np.minimum(toxic, 1 - 1e-9)), minlength=texts) if len(text) else np.zeros(texts), toxic


def score(docs: DataFrame, model: dict[str, np.ndarray], held_out: Column, threshold: float = TOXIC) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of ``docs`` (doc_id, text).

    ``spans`` are the offending stretches, as begin and end in code points of the text.  Null and empty texts have no
    token and the lowest score.  Repeated rows each get their row; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights and a few more
    schema = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<begin:long,end:long>>"
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                part = column.slice(a, b - a)
                hashes, begin, size, text = tokens(part)
                value, toxic = strength(hashes, text, b - a, model)
                out = 1 / (1 + np.exp(-(model["line"][0] + model["line"][1] * np.log1p(value))))
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                for i in np.flatnonzero(toxic >= SPAN).tolist():
                    own = spans[text[i]]
                    if own and i and own[-1]["_i"] == i - 1:
                        own[-1] |= {"end": int(begin[i] + size[i]), "_i": i}
                    else:
                        own.append({"begin": int(begin[i]), "end": int(begin[i] + size[i]), "_i": i})
                for t in {int(text[i]) for i in np.flatnonzero(toxic >= SPAN)}:
                    raw = part[t].as_py().encode()
                    spans[t] = [{k: len(raw[: s[k]].decode(errors="ignore")) for k in ("begin", "end")} for s in spans[t]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(out), pa.array((out >= threshold).astype(np.int32)), pa.array(spans, kind)],
                    names=["doc_id", "held_out", "score", "predicted", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(predict, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels whose crc32 of the id modulo 3 is not 1 and score every row."""
    held_out = crc_fold("doc_id", 3) == 1
    return score(docs, fit(docs, labels, ~held_out), held_out)
