"""The byte network: chunks, gradient, held-out accuracy, edge rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, label int, part int, at long"
EDGES = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "ümlaut \U0001f642"), (6, "x" * 100_000), (None, "no id"), (4, "a"), (7, "The one and the other. " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def test_chunks_cover_every_window_once():
    from strandlab.llm import byte_cnn as net

    texts = [None, "", "a", "b" * net.STEP, "c" * (net.STEP + 1), "é" * 700, "".join(chr(97 + i % 26) for i in range(5000))]
    found, windows, text = net.chunks(pa.array(["cut off", *texts]).slice(1))
    for t, s in enumerate(texts):
        raw = np.concatenate([np.frombuffer((s or "").encode(), np.uint8).astype(np.int16), np.full(net.WIDTH - 1, net.PAD, np.int16)])
        want = [tuple(raw[i : i + net.WIDTH]) for i in range(len((s or "").encode()))]
        got = [tuple(row[i : i + net.WIDTH]) for row, n in zip(found[text == t], windows[text == t]) for i in range(n)]
        assert got == want


def test_answers_equal_plain_convolution():
    from strandlab.llm import byte_cnn as net

    weights = net.start_weights()
    found, windows, _ = net.chunks(pa.array(["abc def ghi " * 60, "x"]))
    best, place = net.pooled(weights, found, windows, places=True)
    vector = np.concatenate([weights["vector"], np.zeros((1, net.VECTOR))])
    for c in range(len(found)):
        answers = np.array([vector[found[c, i : i + net.WIDTH]].reshape(-1) @ weights["kernel"] for i in range(windows[c])])
        assert np.allclose(best[c, : net.FILTERS], np.maximum(answers.max(axis=0) + weights["bias"], 0), atol=1e-4)
        assert np.allclose(answers[place[c], np.arange(net.FILTERS)], answers.max(axis=0), atol=1e-4)


def test_gradient_equals_differences():
    from strandlab.llm import byte_cnn as net

    weights = {k: w.astype(np.float64) for k, w in net.start_weights(3).items()}
    weights["level"] += 0.1
    texts, labels = pa.array(["The first text, of some length. " * 12, "second", "!!?? ** " * 40, ""]), np.array([1, 0, 0, 1], dtype=np.float32)
    found, windows, text = net.chunks(texts)

    def loss(w):
        best, _ = net.pooled(w, found, windows)
        p = net.probability(w, net.described(w, best, windows, text, len(labels))[2])
        return -np.log(np.where(labels == 1, p, 1 - p)).mean()

    slope, value = net.gradient(weights, found, windows, text, labels)
    assert value == pytest.approx(loss(weights), abs=1e-5)
    random = np.random.default_rng(0)
    for name, w in weights.items():
        step = random.normal(size=w.shape)
        step *= 1e-2 / np.linalg.norm(step)
        up, down = loss(weights | {name: w + step}), loss(weights | {name: w - step})
        expected = float(((slope[name] - net.DECAY * w) * step).sum())
        assert (up - down) / 2 == pytest.approx(expected, rel=0.05, abs=3e-6)


def given(n):
    random = np.random.default_rng(2)
    words = ["stone", "river", "the", "of", "light", "and", "winter", "through", "home", "quiet", "small", "walked"]
    rows, labels = [], []
    for i in range(n):
        size = int(np.exp(random.uniform(1.5, 6)))
        kind = i % 6
        if kind == 0:
            text = " ".join([str(random.choice(words))] * size)
        elif kind == 1:
            text = "!! ".join(w.upper() for w in random.choice(words, size))
        else:
            text = ". ".join(" ".join(random.choice(words, 6)).capitalize() for _ in range(1 + size // 6))
        rows.append((i, text))
        labels.append((i, int(kind > 1), 0))
    return rows, labels


def test_quality_of_held_out_documents(spark):
    from strandlab.llm.byte_cnn import score_quality

    rows, labels = given(900)
    taught = spark.createDataFrame(labels + [(None, 0, 0), (4, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + EDGES)
    got = score_quality(docs, taught).collect()
    assert len(got) == len(rows) + len(EDGES)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 7]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_without_both_labels(spark):
    from strandlab.llm.byte_cnn import fit, score, score_quality
    from pyspark.sql import functions as F

    docs, empty = frame(spark, EDGES), frame(spark, [])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit(docs, one, F.lit(True))
    assert model == {"share": 1.0} and {r["predicted"] for r in score(docs, model, F.lit(False)).collect()} == {1}
    assert score_quality(empty, one).count() == 0
