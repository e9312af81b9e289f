"""Trainings read their rows a fixed number of times, and blocks give the sums of the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.functions.exprs import gaussian_logpdf_full
from strandlab.operators import cluster, mixture, rowblocks, sequences
from strandlab.operators.moments import full_gaussian


def counted(spark, rows, schema):
    """The rows with a column of features whose making is counted."""
    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, schema)
    return df.withColumn("x", F.udf(touch, "array<double>").asNondeterministic()("x")), seen


def points(n=300, labels=("p", "q", "r")):
    random = np.random.default_rng(5)
    return [(str(labels[i % len(labels)]), [float(v) for v in random.normal(size=2) * 2 + 3 * (i % 2)]) for i in range(n)]


@pytest.mark.parametrize("train", ["gmm_select_bic", "gmm_fit", "gmm_grow_discriminative"])
def test_training_reads_the_rows_a_fixed_number_of_times(spark, train):
    rows = points()
    df, seen = counted(spark, rows, "label string, x array<double>")
    arguments = {"gmm_select_bic": {"max_k": 3, "max_iter": 6, "tol": 0.0}, "gmm_fit": {"k": 2, "max_iter": 6, "tol": 0.0}, "gmm_grow_discriminative": {"max_iter": 5, "mean_k": 2.0}}
    getattr(mixture, train)(df, 2, **arguments[train]).collect()
    assert 0 < seen.value <= 4 * len(rows)


def test_fold_likelihood_reads_the_rows_once(spark):
    rows = [(i % 3, x) for i, (_, x) in enumerate(points())]
    df, seen = counted(spark, rows, "fold int, x array<double>")
    got = {r["fold"]: r for r in cluster.cluster_cv_loglik(df, 2, 2, 3, max_iter=4).collect()}
    assert seen.value == len(rows) and {f: r["n"] for f, r in got.items()} == {0: 100, 1: 100, 2: 100}


def test_blocks_give_the_sums_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(rowblocks, "CHUNK_VALUES", 600)
    rows = points(900, [f"g{i}" for i in range(7)] + [None])
    rows = [(None if c == "None" else c, x) for c, x in rows]
    rows = [(c, [None if i % 11 == 0 else x[0], x[1]]) if c != "g3" else (c, [None, x[1]]) for i, (c, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "label string, x array<double>").repartition(3)
    model = mixture.cut(mixture.split_heaviest(mixture.one_gaussian(df, 2)))
    got = {(r["label"], r["comp"]): r for r in mixture.block_sums(rowblocks.row_blocks(df, ["label"], 2), model, ["label"], 2).groupBy("label", "comp").agg(
        F.sum("occ").alias("occ"), F.sum("loglik").alias("loglik"), F.sum("n").alias("n"), F.sum(F.col("s1")[0]).alias("a"), F.sum(F.col("s2")[1]).alias("b")).collect()}
    logs = mixture.with_logs(df, model, ["label"], 2)
    e = logs.select("label", "x", "loglik", F.posexplode(mixture.softmax(F.col("_logs"))).alias("comp", "r"))
    want = e.groupBy("label", "comp").agg(F.sum("r").alias("occ"), F.sum("loglik").alias("loglik"), F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("x")[0]).alias("a"), F.sum(F.col("r") * F.col("x")[1] * F.col("x")[1]).alias("b")).collect()
    assert len(want) == len(got) == 14
    for r in want:
        g = got[r["label"], r["comp"]]
        assert g["n"] == r["n"] and (g["a"] is None) == (r["a"] is None) == (r["label"] == "g3")
        assert np.allclose([g["occ"], g["loglik"], g["a"] or 0.0, g["b"]], [r["occ"], r["loglik"], r["a"] or 0.0, r["b"]], rtol=1e-9)


def test_full_densities_of_any_size_are_one_pass(spark):
    random = np.random.default_rng(8)
    rows = [(i, str(i % 2), (random.normal(size=3) + i % 2).tolist()) for i in range(200)] + [(900, "0", [None, 1.0, 2.0]), (901, "1", [1.0])]
    fit = spark.createDataFrame(rows[:200], "id long, label string, x array<double>")
    df = spark.createDataFrame(rows, "id long, label string, x array<double>")
    model = mixture.cut(full_gaussian(fit, 3))
    plan = mixture.full_classify(df, model, mixture.class_shares(fit).withColumnRenamed("share", "prior"))
    want = fit.join(model, "label").select("id", "label", gaussian_logpdf_full(F.col("x"), F.col("mean"), F.col("factor")).alias("ll"))
    assert "aggregate" not in plan._jdf.queryExecution().toString()  # no interpreted sums inside a row
    got = {(r["row_id"], r["label"]): r for r in plan.collect()}
    assert len(got) == 404 and all(abs(got[r["id"], r["label"]]["loglik"] - r["ll"]) < 1e-9 for r in want.collect())
    assert got[900, "0"]["loglik"] == got[901, "1"]["loglik"] == -1e30
    assert all(abs(got[i, "0"]["prob"] + got[i, "1"]["prob"] - 1) < 1e-12 for i in range(200))


def sequences_of(n=60, nulls=False):
    random = np.random.default_rng(11)
    rows = []
    for i in range(n):
        for t in range(1 + int(random.integers(1, 9))):
            x = (random.normal(size=2) + (3 if t > 2 else 0)).tolist()
            rows.append((i, t, [None, x[1]] if nulls and i % 9 == 4 and t == 1 else x, None if i % 13 == 12 else "ab"[i % 2]))
    return rows


def test_trainings_on_blocks_equal_the_pieces(spark, monkeypatch):
    """Long sequences keep the path over pieces; short ones give the same models from blocks."""
    monkeypatch.setattr(sequences, "BLOCK_FRAMES", 50)
    df = spark.createDataFrame(sequences_of(), "seq_id long, t long, x array<double>, label string").repartition(2).cache()
    t, g = (mixture.cut(m) for m in sequences.initial_models(df, 2, 2))

    def flat(gaussian):
        return {(r["model"], r["state"], r["comp"]): [r["logw"], *r["mean"], *r["var"]] for r in gaussian.collect()}

    def same(a, b):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-7) for k in a)

    for run in (
        lambda: sequences.baum_welch_fit(df, t, g, max_iter=3)[1], lambda: sequences.grow_mixtures(df, t, g, 2, max_iter=2)[1], lambda: sequences.segmental_kmeans(df, 2, 2, max_iter=3)[1]
    ):
        got = flat(run())
        with monkeypatch.context() as patch:
            patch.setattr(sequences, "sequence_blocks", lambda *_: None)
            same(got, flat(run()))


def test_sequence_training_reads_the_frames_a_fixed_number_of_times(spark):
    rows = sequences_of()
    plain = spark.createDataFrame(rows, "seq_id long, t long, x array<double>, label string")
    t, g = (mixture.cut(m) for m in sequences.initial_models(plain, 2, 2))
    df, seen = counted(spark, rows, "seq_id long, t long, x array<double>, label string")
    sequences.baum_welch_fit(df, t, g, max_iter=6, tol=0.0)
    assert 0 < seen.value <= 2 * len(rows)


def test_a_sequence_with_a_null_is_skipped_whole(spark):
    whole = "seq_id long, t long, x array<double>, label string"
    rows = sequences_of(nulls=True)
    broken = {r[0] for r in rows if None in r[2]}
    df, clean = spark.createDataFrame(rows, whole), spark.createDataFrame([r for r in rows if r[0] not in broken], whole)
    t, g = (mixture.cut(m) for m in sequences.initial_models(clean, 2, 2))
    got, want = ({(r["model"], r["state"]): r["mean"] for r in sequences.baum_welch_fit(f, t, g, max_iter=2)[1].collect()} for f in (df, clean))
    assert broken and got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)
