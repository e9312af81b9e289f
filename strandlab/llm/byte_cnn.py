"""Text quality by a convolutional network over bytes, in numpy.

The UTF-8 bytes of a whole text are cut into overlapping chunks, so that every window of ``WIDTH`` bytes lies in exactly one
chunk.  Learned filters run over all windows of a chunk and each keeps its largest answer; a hidden layer turns these
(and the chunk's length) into a description of the chunk, and the mean description of a text's chunks, weighted by
their bytes, gives one probability.  A chunk of varied prose excites most filters somewhere, a chunk of one repeated word few of them.

Learning takes a bounded sample of labelled documents, parted by a hash of their id.  In each round every part starts from
the same weights and takes its own steps over its documents (and short cuttings of good ones, so that a short text is
not taken for a poor one), and the weights of all parts are averaged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import as_text, crc_fold, slices
from strandlab.session import cut

#: Learning documents of each label at most, parts they are learned in, least gain of a round, rounds without that gain, good texts per cutting.
TRAIN_ROWS, PARTS, GAIN, PATIENCE, CUTTINGS = 1_200, 6, 0.002, 2, 4
#: Bytes of a window, new windows of a chunk (a chunk shares ``WIDTH - 1`` bytes with the next), size of a byte's vector, filters, hidden units.
WIDTH, STEP, VECTOR, FILTERS, HIDDEN = 9, 248, 8, 32, 16
#: Chunks treated at once, and in one learning step; step size, weight decay, bytes of text at once, score from which quality is 1.
BLOCK, BATCH, RATE, DECAY, CHUNK, GOOD = 64, 384, 0.004, 1e-5, 1_000_000, 0.3
PAD = 256

Weights = dict[str, np.ndarray]


def start_weights(seed: int = 7) -> Weights:
    random = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (random.normal(size=shape) * scale).astype(np.float32)

    return {
        "vector": normal(PAD, VECTOR, scale=0.5), "kernel": normal(WIDTH * VECTOR, FILTERS, scale=(2 / (WIDTH * VECTOR)) ** 0.5), "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS + 1, HIDDEN, scale=(2 / FILTERS) ** 0.5), "shift": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=HIDDEN**-0.5), "level": np.zeros(1, np.float32),
    }


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all chunks (chunk x place, PAD after a text's end), bytes of each that begin a window, and the chunk's text."""
    texts = as_text(texts)
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    end = np.cumsum(size)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[: end[-1]] if len(size) and end[-1] else np.zeros(0, np.uint8)
    count = -(-size // STEP)
    text = np.repeat(np.arange(len(size)), count)
    begin = (end - size)[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    at = begin[:, None] + np.arange(STEP + WIDTH - 1)
    found = data[np.minimum(at, max(0, len(data) - 1))].astype(np.int16) if len(text) else np.zeros((0, STEP + WIDTH - 1), np.int16)
    found[at >= end[text][:, None]] = PAD
    return found, np.minimum(STEP, end[text] - begin), text


def pooled(weights: Weights, found: np.ndarray, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter in each chunk and the share of its windows in use; and the winning windows (if ``places``)."""
    best, place = np.zeros((len(found), FILTERS), np.float32), np.zeros((len(found) if places else 0, FILTERS), np.int64)
    vector = np.concatenate([weights["vector"], np.zeros((1, VECTOR), np.float32)])
    for a in range(0, len(found), BLOCK):
        rows = vector[found[a : a + BLOCK]].reshape(-1, (STEP + WIDTH - 1) * VECTOR)
        seen = np.lib.stride_tricks.sliding_window_view(rows, WIDTH * VECTOR, axis=1)[:, ::VECTOR]
        answer = (np.ascontiguousarray(seen).reshape(-1, WIDTH * VECTOR) @ weights["kernel"]).reshape(len(rows), STEP, FILTERS)
        short = np.flatnonzero(windows[a : a + BLOCK] < STEP)
        for c in short.tolist():
            answer[c, windows[a + c] :] = -np.inf
        if places:
            place[a : a + BLOCK] = answer.argmax(axis=1)
        best[a : a + BLOCK] = answer.max(axis=1)
    length = np.log1p(windows) / np.log1p(STEP)
    return np.column_stack([np.maximum(best + weights["bias"], 0), length.astype(np.float32)]), place


def described(weights: Weights, best: np.ndarray, windows: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden layer of each chunk, the share of its text, and the mean description of each text (zeros without a chunk)."""
    hidden = np.maximum(best @ weights["hidden"] + weights["shift"], 0)
    share = (windows / np.maximum(1, np.bincount(text, windows, minlength=texts))[text]).astype(np.float32)
    mean = np.zeros((texts, HIDDEN), np.float32)
    np.add.at(mean, text, hidden * share[:, None])
    return hidden, share, mean


def probability(weights: Weights, mean: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(mean @ weights["out"] + weights["level"], -30, 30)))


def gradient(weights: Weights, found: np.ndarray, windows: np.ndarray, text: np.ndarray, labels: np.ndarray) -> tuple[Weights, float]:
    """Gradient of the mean log loss of texts with ``labels`` by back-propagation, and the loss."""
    best, place = pooled(weights, found, windows, places=True)
    hidden, share, mean = described(weights, best, windows, text, len(labels))
    p = probability(weights, mean)
    loss = -np.log(np.maximum(np.where(labels == 1, p, 1 - p), 1e-9)).mean()
    miss = ((p - labels) / len(labels)).astype(np.float32)
    to_hidden = (miss[:, None] * weights["out"])[text] * share[:, None] * (hidden > 0)
    to_best = ((to_hidden @ weights["hidden"].T) * (best > 0))[:, :FILTERS]
    kernel = weights["kernel"].reshape(WIDTH, VECTOR, FILTERS)
    vector = np.concatenate([weights["vector"], np.zeros((1, VECTOR), np.float32)])
    to_kernel, to_vector = np.zeros((WIDTH, VECTOR, FILTERS), np.float32), np.zeros((PAD + 1, VECTOR), np.float32)
    chunk = np.arange(len(found))[:, None]
    for j in range(WIDTH):  # the byte at place j of each winning window
        byte = found[chunk, place + j]
        to_kernel[j] = np.einsum("cf,cfv->vf", to_best, vector[byte])
        for v in range(VECTOR):
            to_vector[:, v] += np.bincount(byte.reshape(-1), (to_best * kernel[j, v]).reshape(-1), minlength=PAD + 1)
    out = {
        "vector": to_vector[:PAD], "kernel": to_kernel.reshape(-1, FILTERS), "bias": to_best.sum(axis=0), "hidden": best.T @ to_hidden, "shift": to_hidden.sum(axis=0),
        "out": mean.T @ miss, "level": miss.sum(keepdims=True),
    }
    return {k: out[k] + DECAY * weights[k] for k in out}, float(loss)


class Steps:
    """Adam steps; its state is the weights, both running means and the number of steps."""

    def __init__(self, state: dict | None = None):
        weights = start_weights()
        self.state = state or {"weights": weights, "slope": {k: np.zeros_like(w) for k, w in weights.items()}, "square": {k: np.zeros_like(w) for k, w in weights.items()}, "steps": 0}

    def take(self, slope: Weights) -> None:
        s = self.state
        s["steps"] += 1
        for k, g in slope.items():
            s["slope"][k] = 0.9 * s["slope"][k] + 0.1 * g
            s["square"][k] = 0.999 * s["square"][k] + 0.001 * g * g
            mean, square = s["slope"][k] / (1 - 0.9 ** s["steps"]), s["square"][k] / (1 - 0.999 ** s["steps"])
            s["weights"][k] = s["weights"][k] - RATE * mean / (np.sqrt(square) + 1e-8)


def average(states: list[tuple[dict, int]]) -> dict:
    """The mean of states, weighted by their documents."""
    total = sum(n for _, n in states)
    mean = lambda name, k: sum(s[name][k] * np.float32(n / total) for s, n in states)
    return {name: {k: mean(name, k) for k in states[0][0][name]} for name in ("weights", "slope", "square")} | {"steps": max(s["steps"] for s, _ in states)}


def cuttings(texts: pa.Array, seed: int) -> pa.Array:
    """One piece of each text, of 5 to 400 characters at a place of chance."""
    random = np.random.default_rng(seed)
    size = np.exp(random.uniform(np.log(5), np.log(400), len(texts))).astype(int).tolist()
    at = random.random(len(texts)).tolist()
    return pa.array([t[(a := int(p * max(1, len(t) - n))) : a + n] for t, n, p in zip(texts.to_pylist(), size, at)], pa.large_string())


def learning_rows(docs: DataFrame, labels: DataFrame, learning: Column, rows: int) -> DataFrame:
    """(label, text, part, at) of at most ``rows`` documents of each label, those with the smallest hash of their id.

    Of several labels of a document the largest counts, of several texts the last in order; nulls teach nothing.
    """
    named = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.max("quality").alias("label")).filter(learning)
    named = named.select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id", F.lit(13)).alias("at"))
    chosen = cut(named.filter("label = 0").orderBy("at").limit(rows).unionByName(named.filter("label = 1").orderBy("at").limit(rows)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids
    one = texts.groupBy("doc_id", "label", "at").agg(F.max("text").alias("text")).select("label", "text", "at", F.pmod("at", F.lit(PARTS)).cast("int").alias("part"))
    return cut(one.repartition(PARTS, "part").sortWithinPartitions("part", "at"))


def fit(docs: DataFrame, labels: DataFrame, learning: Column, rows: int = TRAIN_ROWS) -> dict:
    """Weights, or only the share of label 1 where the learning rows do not show both labels (0.5 without any).

    Rounds end when the mean loss of ``PATIENCE`` rounds in a row has not fallen by ``GAIN``.  Bounds: ``rows`` documents of
    a label, and the weights, which are all that reaches the driver.
    """
    taught = learning_rows(docs, labels, learning, rows)
    counts = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    if len(counts) < 2:
        return {"share": float(next(iter(counts), 0.5))}
    ordered = taught.repartition(PARTS, "part").sortWithinPartitions("part", "at")
    state, low, waited, kept = Steps().state, np.inf, 0, None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, loss, seen = Steps(state), 0.0, 0
        for batch in batches:
            column, flags = as_text(batch.column("text")), np.asarray(batch.column("label"), dtype=np.float32)
            for a, b in slices(column, BATCH * STEP):
                whole = as_text(column.slice(a, b - a))
                some = np.flatnonzero(flags[a:b] == 1)[steps.state["steps"] % CUTTINGS :: CUTTINGS]  # a piece of a good text is good, one of a bad text need not be bad
                both = pa.concat_arrays([whole, cuttings(whole.take(pa.array(some)), steps.state["steps"])])
                slope, miss = gradient(steps.state["weights"], *chunks(both), np.append(flags[a:b], np.ones(len(some), np.float32)))
                steps.take(slope)
                loss, seen = loss + miss * (b - a), seen + b - a
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(steps.state)], pa.binary()), pa.array([loss]), pa.array([seen])], names=["state", "loss", "seen"])

    while waited < PATIENCE:
        found = ordered.mapInArrow(learn, "state binary, loss double, seen long").collect()  # PARTS sets of weights
        found.sort(key=lambda r: (r["seen"], bytes(r["state"])))
        state = average([(pickle.loads(r["state"]), r["seen"]) for r in found])
        loss = sum(r["loss"] for r in found) / sum(r["seen"] for r in found)
        waited = 0 if loss < low - GAIN else waited + 1
        if loss < low:
            low, kept = loss, state["weights"]
    return {"weights": kept}


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    """Probability of label 1 of each whole text; null is the empty text."""
    if "share" in model:
        return np.full(len(texts), model["share"])
    found, windows, text = chunks(texts)
    best, _ = pooled(model["weights"], found, windows)
    return probability(model["weights"], described(model["weights"], best, windows, text, len(texts))[2]).astype(np.float64)


def score(docs: DataFrame, model: dict, held_out: Column, threshold: float = GOOD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text); ``predicted`` is 1 from ``threshold`` on.

    Null and empty texts have no chunk and the score of the network's level alone.  Repeated rows and a null ``doc_id``
    each get their row, other columns are not read, and an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand weights

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                out = score_texts(column.slice(a, b - a), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels whose crc32 of the id modulo 5 is not 0 and score every row."""
    held_out = crc_fold("doc_id", 5) == 0
    return score(docs, fit(docs, labels, ~held_out), held_out)
