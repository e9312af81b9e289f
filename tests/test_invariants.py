"""Properties that hold for any data, brute-force checks and edge rows."""

import collections
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlab.functions.exprs import parse_ranges
from strandlab.functions.tails import incomplete_beta
from strandlab.operators import bayes, cluster, counts, decode, itemsets, mixture, moments, prep, rules, sequences, series
from strandlab.plans import ensemble, evaluate, folds, learners, search
from strandlab.session import fresh_path
from strandlab.sources import instances, store
from strandlab.streaming import stream

ATTRS = ["a", "b"]


@pytest.fixture(scope="module")
def nominal(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(300), "a": rng.choice(list("xyz"), 300), "b": rng.choice(list("pq"), 300)})
    pdf["label"] = np.where((pdf["a"] == "x") ^ (rng.random(300) < 0.2), "yes", "no")
    return pdf, spark.createDataFrame(pdf)


# -- ranges, preprocessing --------------------------------------------------------


def test_parse_ranges():
    assert parse_ranges("first-3,last", 6) == [0, 1, 2, 5]
    assert parse_ranges("2", 3, invert=True) == [0, 2]
    with pytest.raises(ValueError):
        parse_ranges("3-2", 5)
    with pytest.raises(ValueError):
        parse_ranges("9", 5)


def test_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None, "x"), (2, 5.0, None, None), (3, None, None, "x")], "id int, c double, gone double, n string")
    out = prep.drop_all_missing_columns(df)
    assert out.columns == ["id", "c", "n"]
    assert [r["c"] for r in prep.minmax_scale(out, out, ["c"]).orderBy("id").collect()] == [0.0, 0.0, None]
    assert [r["c"] for r in prep.standardize(out, out, ["c"]).orderBy("id").collect()] == [0.0, 0.0, None]
    filled = prep.impute_mean_mode(out, out, ["c"], ["n"]).orderBy("id").collect()
    assert [r["c"] for r in filled] == [5.0] * 3 and [r["n"] for r in filled] == ["x"] * 3


def test_union_requires_equal_schema(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    with pytest.raises(ValueError):
        instances.union_sets(a, spark.createDataFrame([(1, 2)], "i int, s int"))


def test_nan_becomes_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"), "a")], "x double, y string").write.parquet(str(tmp_path / "d"))
    assert instances.load_instances(spark, str(tmp_path / "d")).first()["x"] is None


# -- counting learners --------------------------------------------------------------


def test_single_class_and_empty(spark, nominal):
    _, df = nominal
    one = df.filter("label = 'yes'")
    assert all(abs(r["gain"]) < 1e-9 for r in counts.info_gain(counts.contingency(one, ATTRS)).collect())
    assert rules.id3_tree(one, ATTRS).count() == 1
    assert counts.contingency(df.limit(0), ATTRS).count() == 0


def test_row_order_and_partitions_do_not_matter(nominal):
    _, df = nominal
    a = sorted(map(tuple, counts.contingency(df, ATTRS).collect()))
    b = sorted(map(tuple, counts.contingency(df.repartition(13).orderBy(F.rand(4)), ATTRS).collect()))
    assert a == b
    x = sorted(map(tuple, folds.assign_folds(df, 5).select("id", "fold").collect()))
    y = sorted(map(tuple, folds.assign_folds(df.repartition(9), 5).select("id", "fold").collect()))
    assert x == y


def test_probabilities_sum_to_one(nominal):
    _, df = nominal
    m = bayes.naive_bayes_fit(df, ATTRS)
    out = bayes.naive_bayes_score(df, m["prior"].select("label", "prior"), m["nominal"], ATTRS)
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in out.select("probs").collect())
    bag = ensemble.bagging(df, df.drop("label"), learners.NaiveBayes(ATTRS), bags=3)
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in bag.select("probs").collect())


def test_folds_are_stratified(nominal):
    _, df = nominal
    per = folds.assign_folds(df, 7).groupBy("label", "fold").count().toPandas()
    for _, g in per.groupby("label"):
        assert g["count"].max() - g["count"].min() <= 1


def _prism(pdf, attrs):
    """Plain separate-and-conquer on rows, for comparison."""
    out = []
    for target in sorted(pdf["label"].unique()):
        e, n = pdf, 0
        while (e["label"] == target).any():
            cover, used, test = e, [], []
            while (cover["label"] != target).any() and len(used) < len(attrs):
                best = None
                for pos, a in enumerate(attrs):
                    if a in used:
                        continue
                    for v, g in cover.groupby(a):
                        k = (g["label"] == target).sum()
                        key = (-round(k / len(g), 12), -k, pos, v)
                        if best is None or key < best[0]:
                            best = (key, a, v)
                used.append(best[1])
                test.append(f"{best[1]}={best[2]}")
                cover = cover[cover[best[1]] == best[2]]
            n += 1
            out.append((target, n, tuple(sorted(test)), len(cover), (cover["label"] == target).sum()))
            e = e.drop(cover.index)
    return sorted(out)


def test_covering_rules_match_plain_version(nominal):
    pdf, df = nominal
    got = rules.covering_rules(df, ATTRS)
    rows = sorted((r["target"], r["rule"], tuple(r["test"]), int(r["covers"]), int(r["correct"])) for r in got.collect())
    assert rows == _prism(pdf, ATTRS)


def test_rule_sides_partition_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, a string")
    inside, outside = rules.covered_by(df, {"a": "x"}).count(), rules.not_covered_by(df, {"a": "x"}).count()
    assert (inside, outside) == (1, 2)


def test_itemsets_respect_upper_bound(nominal):
    pdf, df = nominal
    out = itemsets.frequent_itemsets(df, ["a", "b", "label"], 0.05, 0.5)
    rows = out.collect()
    assert rows and all(15 <= r["n"] <= 150 for r in rows)
    for r in rows:
        hit = pd.Series(True, index=pdf.index)
        for item in r["itemset"]:
            a, v = item.split("=")
            hit &= pdf[a] == v
        assert hit.sum() == r["n"]


# -- mixtures -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal([0, 0] if i % 3 else [4, 4], 1.0)], "one") for i in range(300)]
    rows += [(1000 + i, [float(v) for v in rng.normal([9, -3], 0.7)], "two") for i in range(100)]
    return spark.createDataFrame(rows, "id long, x array<double>, label string")


def test_em_never_loses_likelihood(points):
    model = mixture.split_heaviest(mixture.one_gaussian(points, 2))
    seen = []
    for _ in range(5):
        step = mixture.gmm_em_step(points, model, 2)
        seen.append(step.groupBy("label").agg(F.max("loglik").alias("l")).orderBy("label").toPandas()["l"].to_numpy())
        model = mixture.cut(step.drop("loglik", "n"))
    assert (np.diff(np.array(seen), axis=0) >= -1e-6).all()


def test_bic_finds_two_and_one(points):
    k = mixture.gmm_select_bic(points, 2, max_iter=15, max_k=4).groupBy("label").count().toPandas().set_index("label")["count"]
    assert k["one"] == 2 and k["two"] == 1


def test_classify_parts_agree(points, monkeypatch):
    model = mixture.cut(mixture.gmm_fit(points, 2, 2, max_iter=4))
    one = mixture.gmm_classify(points, model).orderBy("row_id", "label").toPandas()
    monkeypatch.setattr(mixture, "MODEL_PART", 2)
    many = mixture.gmm_classify(points, model).orderBy("row_id", "label").toPandas()
    assert np.allclose(one["prob"], many["prob"])
    assert np.allclose(one.groupby("row_id")["prob"].sum(), 1.0)


def test_discriminative_step_raises_posterior(points):
    def posterior(model):
        p = mixture.gmm_classify(points, model, points.groupBy("label").agg((F.count(F.lit(1)) / 400.0).alias("prior")))
        own = p.join(points.select(F.col("id").alias("row_id"), "label"), ["row_id", "label"])
        return own.agg(F.avg(F.log("prob"))).first()[0]

    start = mixture.cut(mixture.one_gaussian(points, 2))
    after = mixture.gmm_discriminative_step(points, start, 2)
    assert posterior(after.drop("surplus")) > posterior(start)


def test_mapping_is_optimal(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(0, 30, (4, 5))
    rows = [(f"c{i}", j, int(m[i, j])) for i in range(4) for j in range(5) if m[i, j]]
    got = cluster.map_clusters(spark.createDataFrame(rows, "label string, cluster int, n long")).first()["errors"]
    best = max(sum(m[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
    assert got == m.sum() - best


def test_codebook_reduces_cost(points):
    one = cluster.kmeans_codebook(points, 2, 1)
    four = cluster.kmeans_codebook(points, 2, 4)
    cost = [cluster.assign_codewords(points, b).agg(F.avg("dist")).first()[0] for b in (one, four)]
    assert four.count() == 4 and cost[1] < cost[0] / 2


def test_covariance_matches_numpy(points):
    x = np.array([r["x"] for r in points.filter("label = 'one'").collect()])
    got = {(r["i"], r["j"]): r["cov"] for r in moments.weighted_covariance(points, 2, None, ["label"]).filter("label = 'one'").collect()}
    want = np.cov(x.T, bias=True)
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(2) for j in range(2))


# -- decoding -------------------------------------------------------------------------


def test_elimination_matches_plain_fold(spark):
    rng = np.random.default_rng(9)
    dom = spark.createDataFrame([(i, c) for i, c in enumerate("abcd")], "pos int, label string")
    code = decode.code_all_pairs(dom)
    pairs = list(itertools.combinations("abcd", 2))
    scores = [(r, k, float(s)) for r in range(40) for k, s in enumerate(rng.normal(size=6))]
    got = {r["row_id"]: r["predicted"] for r in decode.decode_elimination(spark.createDataFrame(scores, "row_id long, clf int, score double"), code).collect()}
    for row in range(40):
        out = set()
        for (minus, plus), (_, _, s) in zip(pairs, [x for x in scores if x[0] == row]):
            if minus not in out and plus not in out:
                out.add(minus if s > 0 else plus)
        assert got[row] == next(c for c in "abcd" if c not in out)


def test_two_class_code_has_one_row(spark):
    dom = spark.createDataFrame([(0, "n"), (1, "y")], "pos int, label string")
    assert sorted(map(tuple, decode.code_one_vs_rest(dom).collect())) == [(0, "n", -1), (0, "y", 1)]


# -- evaluation -------------------------------------------------------------------------


def test_tail_probabilities():
    t, df = np.array([2.2621571628, 0.0, 12.706204736]), np.array([9.0, 5.0, 1.0])
    assert np.allclose(incomplete_beta(df / 2, np.full(3, 0.5), df / (df + t * t)), [0.05, 1.0, 0.05], atol=1e-6)


def test_identical_schemes(spark):
    rows = [(s, i, "a", "a" if i % 2 else "b") for s in ("p", "q") for i in range(10)]
    preds = spark.createDataFrame(rows, "scheme string, row_id long, actual string, predicted string")
    r = evaluate.mcnemar(preds).first()
    assert r["statistic"] is None and r["equivalent"] and r["only_x"] == 0
    b = evaluate.bootstrap_diff(evaluate.outcome_table(preds), draws=1000).first()
    assert (b["lower"], b["upper"], b["draws"]) == (0.0, 0.0, 1000) and b["equivalent"]


def test_result_guards(spark):
    rows = [("d", "s", 0, 0.1), ("d", "s", 0, 0.2), ("d", "t", 0, 0.3), ("d", "t", 1, None)]
    res = spark.createDataFrame(rows, "dataset string, scheme string, fold int, error double")
    bad = {r["scheme"]: r["problem"] for r in folds.average_violations(res, ["dataset", "scheme"], "fold", 3).collect()}
    assert bad == {"s": "duplicate key", "t": "wrong count"}
    avg = {r["scheme"]: r["avg_error"] for r in folds.average_results(res, ["dataset", "scheme"], ["error"]).collect()}
    assert avg["t"] is None and abs(avg["s"] - 0.15) < 1e-12
    assert evaluate.unpaired_results(res.withColumn("run", F.lit(1))).count() == 2


def test_failing_cell_does_not_stop_the_grid(spark):
    def cell(c):
        if c["k"] == 2:
            raise ValueError("bad")
        return spark.createDataFrame([(c["k"] * 1.0,)], "error double")

    done, status = folds.run_grid([{"k": k} for k in (1, 2, 3)], cell, ["k"])
    assert sorted(r["k"] for r in done.collect()) == [1, 3] and status[1]["status"].startswith("ValueError")


def test_results_are_computed_once(spark):
    path, calls = fresh_path(spark, "store"), []
    keys = spark.createDataFrame([("a",), ("b",)], "k string")

    def compute(todo):
        calls.append(sorted(r["k"] for r in todo.collect()))
        return todo.withColumn("v", F.lit(1.0))

    store.append_results_once(spark, path, keys.limit(1), ["k"], compute)
    store.append_results_once(spark, path, keys, ["k"], compute)
    assert store.append_results_once(spark, path, keys, ["k"], compute).count() == 2 and len(calls) == 2 and calls[0] != calls[1]


def test_race_finds_the_informative_attribute(nominal):
    _, df = nominal
    steps = search.hill_race(df, ATTRS, folds=4).collect()
    assert steps[-1]["subset_id"].split("+")[0] == "a"
    cv = {r["subset_id"]: r["error"] for r in search.subset_eval_cv({"a": ["a"], "b": ["b"]}, df, repeats=2).collect()}
    assert cv["a"] < cv["b"]


def test_doubling_search():
    value, error, trace = search.doubling_search(lambda g: abs(math.log2(g) - 3), 1.0)
    assert value == 8.0 and error == 0.0 and len(trace) < 12


def test_doubling_search_asks_for_values_together():
    for f, attempts, limit in ((lambda g: abs(math.log2(g) - 3), 3, None), (lambda g: abs(math.log2(g) + 4), 2, None), (lambda g: abs(math.log2(g) - 5), 3, 7), (lambda g: 1.0, 3, 3)):
        alone, asked = [], []
        single = search.doubling_search(lambda g: alone.append(g) or f(g), 1.0, attempts, limit)
        many = search.doubling_search(f, 1.0, attempts, limit, together=lambda v: asked.append(v) or [f(g) for g in v])
        assert many == single and sorted(alone) == sorted(sum(asked, [])) == sorted(g for g, _ in many[2])
        assert len(asked) < len(alone)


def test_bag_weights_filter_hashes_once(spark):
    import hashlib

    out = ensemble.bag_weights(spark.range(200), 3)
    want = {}
    for i in range(200):
        for bag in range(3):
            u, w, p, total = int(hashlib.md5(f"{i}|0:{bag}".encode()).hexdigest()[:8], 16) / 2**32, 0, math.exp(-1.0), 0.0
            for k in range(15):
                total += p
                w += u >= total
                p /= k + 1
            if w:
                want[i, bag] = w
    assert {(r["id"], r["bag"]): r["bw"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("md5(") for line in plan.splitlines() if "Filter" in line) == 1


def test_full_weight_bag_equals_base(nominal, monkeypatch):
    _, df = nominal
    monkeypatch.setattr(ensemble, "poisson_draw", lambda u, rate: F.lit(1))
    bag = ensemble.bagging(df, df.drop("label"), learners.NaiveBayes(ATTRS), bags=1).select("id", "probs").orderBy("id").toPandas()
    m = bayes.naive_bayes_fit(df, ATTRS)
    base = bayes.naive_bayes_score(df, m["prior"].select("label", "prior"), m["nominal"], ATTRS).select("id", "probs").orderBy("id").toPandas()
    assert np.allclose(np.vstack(bag["probs"]), np.vstack(base["probs"]))


# -- sequence models ----------------------------------------------------------------------


def _frames(spark, seqs, label="m"):
    rows = [(i, t, [float(v)], label) for i, s in enumerate(seqs) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "seq_id long, t long, x array<double>, label string")


def _toy(spark):
    arcs = [(0, 1, 0.7), (0, 2, 0.3), (1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2), (2, 1, 0.2), (2, 2, 0.4), (2, 3, 0.4)]
    t = spark.createDataFrame([("m", i, j, math.log(p)) for i, j, p in arcs], "model string, i int, j int, logp double")
    g = [("m", 1, 0, math.log(0.6), [0.0], [1.0]), ("m", 1, 1, math.log(0.4), [1.0], [0.5]), ("m", 2, 0, 0.0, [3.0], [1.0])]
    return arcs, t, spark.createDataFrame(g, "model string, state int, comp int, logw double, mean array<double>, var array<double>")


def _density(state, x):
    n = lambda m, v: math.exp(-0.5 * (x - m) ** 2 / v) / math.sqrt(2 * math.pi * v)
    return 0.6 * n(0, 1) + 0.4 * n(1, 0.5) if state == 1 else n(3, 1)


def test_viterbi_and_likelihood_by_enumeration(spark):
    arcs, t, g = _toy(spark)
    a = {(i, j): p for i, j, p in arcs}
    seqs = [[0.1, 2.5, 3.0, 0.2], [3.1], [0.0, 0.5]]
    frames = _frames(spark, seqs)
    got = {r["seq_id"]: r["total"] for r in sequences.viterbi_score(frames, t, g).collect()}
    states = {}
    for r in sequences.viterbi_path(frames, t, g).orderBy("seq_id", "t").collect():
        states.setdefault(r["seq_id"], []).append(r["state"])
    total = 0.0
    for i, s in enumerate(seqs):
        probs = {}
        for path in itertools.product((1, 2), repeat=len(s)):
            p = a[0, path[0]] * a[path[-1], 3]
            for u, v in zip(path, path[1:]):
                p *= a[u, v]
            for st, x in zip(path, s):
                p *= _density(st, x)
            probs[path] = p
        best = max(probs, key=probs.get)
        assert abs(got[i] - math.log(probs[best])) < 1e-9 and states[i] == list(best)
        total += math.log(sum(probs.values()))
    _, _, stats = sequences.baum_welch_step(frames, t, g)
    assert abs(sequences.mean_loglik(stats)[0] - total / 3) < 1e-9


def test_baum_welch_never_loses_likelihood(spark):
    rng = np.random.default_rng(4)
    seqs = [np.r_[rng.normal(0, 1, 6), rng.normal(5, 1, 5)] for _ in range(20)]
    frames = _frames(spark, seqs)
    t, g = sequences.initial_models(frames, 2, 1)
    t2, g2, trace = sequences.baum_welch_fit(frames, t, g, max_iter=5)
    assert (np.diff(trace) >= -1e-9).all()
    means = sorted(r["mean"][0] for r in g2.collect())
    assert abs(means[0]) < 0.5 and abs(means[1] - 5) < 0.5


def test_embedded_step_with_one_label_equals_plain_step(spark):
    _, t, g = _toy(spark)
    frames = _frames(spark, [[0.1, 2.5, 3.0], [0.0, 0.5, 2.0, 3.0]])
    words = frames.select("seq_id").distinct().withColumns({"pos": F.lit(0), "label": F.lit("m")})
    a = sequences.baum_welch_step(frames, t, g)[1].orderBy("state", "comp").collect()
    b = sequences.embedded_step(frames, words, t, g)[1].orderBy("state", "comp").collect()
    assert a == b
    tied = sequences.embedded_step(frames, words.withColumn("label", F.lit("logical")), t, g, spark.createDataFrame([("logical", "m")], "label string, model string"))
    assert tied[1].orderBy("state", "comp").collect() == a


def test_embedded_chain_pools_statistics(spark):
    _, t, g = _toy(spark)
    frames = _frames(spark, [[0.1, 2.5, 3.0, 0.2, 3.3]])
    words = spark.createDataFrame([(0, 0, "m"), (0, 1, "m")], "seq_id long, pos int, label string")
    for piece in (2048, 2):
        _, _, stats = sequences.embedded_step(frames, words, t, g, piece=piece, fan=2)
        occ = {(r["kind"], r["a"]): r["o"] for r in stats.groupBy("kind", "a").agg(F.sum("occ").alias("o")).collect()}
        assert abs(occ["gauss", 1] + occ["gauss", 2] - 5) < 1e-6  # every frame once
        assert abs(occ["trans", 0] - 2) < 1e-6  # both copies are entered once


def test_short_and_impossible_sequences(spark):
    _, t, g = _toy(spark)
    no_single = t.filter("NOT (i = 1 AND j = 3)").filter("NOT (i = 0 AND j = 2)")  # needs two frames
    frames = _frames(spark, [[0.0], [0.0, 3.0]])
    got = {r["seq_id"]: r["score"] for r in sequences.viterbi_score(frames, no_single, g).collect()}
    assert got[0] is None and got[1] is not None
    best = {r["seq_id"]: r["predicted"] for r in series.best_model(sequences.viterbi_score(frames, no_single, g)).collect()}
    assert best == {0: None, 1: "m"}
    _, _, stats = sequences.baum_welch_step(frames, no_single, g)
    assert sequences.mean_loglik(stats)[1:] == (1, 1)
    assert series.uniform_segmentation(frames, 2).select("seq_id").distinct().count() == 1


# -- streams ------------------------------------------------------------------------------


def test_stream_in_many_batches_equals_batch(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(200), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(range(200), unit="min"), "key": rng.integers(0, 4, 200), "v": rng.random(200)})
    df = spark.createDataFrame(pdf)
    path = stream.new_path(spark, "t")
    out = stream.replay(df, "ts", lambda s: stream.run_translate(s, "key", ["ts", "id"], ["v"], 3, path), parts=4)
    want = series.translate_series(df, ["key"], ["ts", "id"], ["v"], 3)
    assert sorted((r["id"], r["v"]) for r in out.collect()) == sorted((r["id"], r["v"]) for r in want.collect())


def test_stream_late_rows_stay_in_the_window(spark):
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:05:00", 1), (3, "2024-01-01 00:02:00", 1), (3, "2024-01-01 00:02:00", 1)]
    df = spark.createDataFrame(rows, "id long, s string, key int").withColumn("ts", F.to_timestamp("s")).drop("s")
    path = fresh_path(spark, "late")
    for i in range(len(rows)):
        df.filter(F.col("id") == rows[i][0]).limit(1).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    win = stream.run_fifo(stream.watermarked(src, "ts", "id"), "key", ["ts", "id"], 2, stream.new_path(spark, "f"))
    assert sorted(r["id"] for r in win.collect()) == [2, 3]


def test_no_prediction_is_an_error(spark):
    from strandlab.plans import evaluate

    rows = spark.createDataFrame([("x", 1, "a", "a"), ("x", 2, "a", None), ("x", 3, "b", None), ("y", 1, "a", "a"), ("y", 2, "a", "a"), ("y", 3, "b", "a")], "scheme string, row_id int, actual string, predicted string")
    only = {r["actual"]: r["error"] for r in evaluate.confusion_matrix(rows.filter("scheme = 'x'"), ["a", "b"]).collect()}
    assert only == {"a": 0.5, "b": 1.0}
    cells = evaluate.outcome_table(rows).first()
    assert (cells["both_right"], cells["only_x"], cells["only_y"], cells["both_wrong"]) == (1, 0, 1, 1)


def test_cell_that_fails_while_running_is_reported(spark):
    from strandlab.plans.folds import run_grid

    def compute(cell):
        return spark.range(3).select(F.raise_error(F.lit("late")).cast("long").alias("n")) if cell["k"] == 2 else spark.range(3).select(F.col("id").alias("n"))

    done, status = run_grid([{"k": 1}, {"k": 2}, {"k": 3}], compute, ["k"])
    assert done.count() == 6 and [s["status"] == "ok" for s in status] == [True, False, True]


def test_broken_store_is_not_an_empty_store(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from strandlab.sources.store import append_results_once

    path = str(tmp_path / "store")
    spark.range(2).select(F.col("id").alias("other")).write.parquet(path)
    with pytest.raises(AnalysisException):
        append_results_once(spark, path, spark.range(2).select(F.col("id").alias("key")), ["key"], lambda todo: todo)


def test_poisson_weights_keep_their_mean(spark):
    from strandlab.functions.exprs import poisson_draw, seeded_uniform

    row = spark.range(20_000).select(poisson_draw(seeded_uniform(F.col("id")), 20.0).alias("w")).agg(F.avg("w"), F.max("w")).first()
    assert abs(row[0] - 20) < 0.2 and row[1] > 30


def test_learners_through_one_cross_validation(nominal):
    from strandlab.plans import crossval, folds

    df = nominal[1] if isinstance(nominal, tuple) else nominal
    attrs = [c for c in df.columns if c not in ("id", "label")][:2]
    got = crossval.cross_validate(df, {"bayes": crossval.NaiveBayes(attrs), "one": crossval.OneAttribute(attrs[0])}, runs=2, k=4)
    assert got.groupBy("scheme", "run").count().select("count").distinct().count() == 1
    plain = folds.cross_validate_bayes(df, attrs, 4, 1).select("id", "predicted")
    same = got.filter("scheme = 'bayes' AND run = 1").join(plain.withColumnRenamed("predicted", "p"), F.col("row_id") == F.col("id"))
    assert same.filter("NOT predicted <=> p").count() == 0 and same.count() == df.filter("label IS NOT NULL").count()


# -- item sets of any size -----------------------------------------------------------------


def test_itemsets_of_every_size(spark):
    """Sets of up to twelve items against counting, with bounds on both sides; every split of a long set."""
    rng = np.random.default_rng(12)
    names = [f"a{i}" for i in range(12)]
    base = rng.integers(0, 2, (90, 12))
    base[:40] = 1  # twelve items that occur together
    rows = [tuple(None if rng.random() < 0.02 else str(v) for v in r) for r in base]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    sets = [frozenset(f"{n}={v}" for n, v in zip(names, r) if v is not None) for r in rows]
    got = {frozenset(r["itemset"]): r["n"] for r in itemsets.frequent_itemsets(df, names, 0.3, 0.95).collect()}
    single = collections.Counter(i for s in sets for i in s)
    lo, hi = itemsets.support_count(0.3, 90), itemsets.support_count(0.95, 90)
    level = {frozenset([i]): n for i, n in single.items() if lo <= n <= hi}
    want = dict(level)
    while level:
        more = {a | b for a in level for b in level if len(a | b) == len(a) + 1}
        level = {s: n for s in more if lo <= (n := sum(s <= t for t in sets)) <= hi}
        want |= level
    assert got == want and max(map(len, got)) > 10
    longest = max(got, key=lambda s: (len(s), sorted(s)))
    part = spark.createDataFrame([(sorted(s), len(s), n) for s, n in got.items() if s <= longest], "itemset array<string>, size int, n long")
    rules = itemsets.association_rules(part, 90, "confidence", 0.0)
    top = rules.filter(F.col("n") == got[longest]).filter(F.size("premise") + F.size("consequence") == len(longest))
    assert top.count() == 2 ** len(longest) - 2
    assert itemsets.chi_critical(0.05) == pytest.approx(3.841458820694124)
    assert itemsets.frequent_itemsets(df, names, 0.3, max_size=2).agg(F.max("size")).first()[0] == 2
    assert itemsets.frequent_itemsets(df.limit(0), names, 0.3).count() == 0
