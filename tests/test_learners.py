"""Count learners, two-stage learning, parameter and subset search, discriminative growth: against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlab.functions.exprs import LOG_ZERO, gaussian_logpdf_full
from strandlab.operators import mixture, moments
from strandlab.operators.bayes import CLASS_ATTR
from strandlab.plans import ensemble, folds, learners, search

ATTRS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def nominal(spark):
    random = np.random.default_rng(4)
    n = 400
    label = random.choice(["x", "y", "z"], n, p=[0.5, 0.3, 0.2])
    a = np.where(random.random(n) < 0.7, label, random.choice(["x", "y", "z"], n))
    b, c = random.choice(["p", "q"], n), np.where(random.random(n) < 0.6, np.where(label == "x", "1", "2"), random.choice(["1", "2", "3"], n))
    pdf = pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c, "label": label})
    pdf.loc[::29, "a"] = None
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, a string, b string, c string, label string")


def bayes(train, test, attrs, smooth=1.0, weight=None):
    """Class probabilities of ``test`` rows; every value and class of ``train`` is known, whatever its weight."""
    w = np.ones(len(train)) if weight is None else weight
    classes = sorted(train["label"].unique())
    prior = np.array([w[train["label"] == c].sum() + 1 for c in classes])
    logs = np.tile(np.log(prior / prior.sum()), (len(test), 1))
    for a in attrs:
        values = sorted(train[a].dropna().unique())
        counts = np.array([[w[(train[a] == v) & (train["label"] == c)].sum() + smooth for c in classes] for v in values])
        p = np.log(counts / counts.sum(axis=0))
        for i, v in enumerate(test[a]):
            if v in values:
                logs[i] += p[values.index(v)]
    z = np.exp(logs - logs.max(axis=1, keepdims=True))
    return classes, z / z.sum(axis=1, keepdims=True)


def predicted(classes, probs):
    return [classes[int(np.argmax(np.round(p, 9)))] for p in probs]


def fold_of(pdf, k, seed=0):
    import hashlib

    h = [hashlib.md5(f"{i}|{seed}".encode()).hexdigest() for i in pdf["id"]]
    order = pdf.assign(h=h).sort_values(["label", "h", "id"])
    return order.groupby("label").cumcount().reindex(pdf.index) % k


def test_counts_by_weight_read_each_row_once(nominal):
    pdf, df = nominal
    weights = [F.lit(1.0), (F.col("id") % 3).cast("double"), F.lit(0.0)]
    got = {(r["w_no"], r["attr"], r["value"], r["label"]): r["w"] for r in learners.counts_by_weight(df, ["a"], weights, "w_no").collect()}
    for i, w in enumerate([np.ones(len(pdf)), pdf["id"].to_numpy() % 3, np.zeros(len(pdf))]):
        for (v, c), g in pdf.dropna(subset=["a"]).groupby(["a", "label"]):
            assert got[i, "a", v, c] == w[g.index].sum()
        for c, g in pdf.groupby("label"):
            assert got[i, CLASS_ATTR, "1", c] == w[g.index].sum()


@pytest.mark.parametrize("vote", [False, True])
def test_bagging_any_learner(nominal, vote):
    from strandlab.functions.exprs import poisson_draw, seeded_uniform

    pdf, df = nominal
    draws = df.select("id", *[poisson_draw(seeded_uniform(F.col("id"), f"0:{b}"), 1.0).alias(f"w{b}") for b in range(4)]).orderBy("id").toPandas()
    out = ensemble.bagging(df, df.drop("label"), learners.NaiveBayes(ATTRS), bags=4, vote=vote).orderBy("id").select("probs").toPandas()
    parts = [bayes(pdf, pdf, ATTRS, weight=draws[f"w{b}"].to_numpy(float))[1] for b in range(4)]
    if vote:
        parts = [np.eye(3)[np.argmax(np.round(p, 9), axis=1)] for p in parts]
    assert np.allclose(np.vstack(out["probs"]), np.mean(parts, axis=0))


def test_stack_learns_from_unseen_scores(nominal):
    pdf, df = nominal
    k, test = 4, pdf[pdf["id"] % 5 == 0].reset_index(drop=True)
    train = pdf[pdf["id"] % 5 != 0].reset_index(drop=True)
    stack = ensemble.Stack({"bayes": learners.NaiveBayes(["a", "b"]), "rule": learners.OneAttribute("c")}, learners.NaiveBayes, ["x", "y", "z"], levels=5)
    got = stack.score(df.filter("id % 5 = 0"), stack.fit(df.filter("id % 5 <> 0"), k=k)).orderBy("id").toPandas()

    def rule(tr, te):
        best = {v: min(g["label"].unique(), key=lambda c: (-(g["label"] == c).sum(), c)) for v, g in tr.groupby("c")}
        top = min(tr["label"].unique(), key=lambda c: (-(tr["label"] == c).sum(), c))
        return np.array([[float(best.get(v, top) == c) for c in ("x", "y", "z")] for v in te["c"]])

    def features(tr, te):
        both = np.hstack([bayes(tr, te, ["a", "b"])[1], rule(tr, te)])
        return pd.DataFrame(np.minimum(4, np.floor(np.round(both, 9) * 5)).astype(int).astype(str), columns=stack.features)

    fold = fold_of(train, k)
    meta = pd.concat([features(train[fold != f], train[fold == f]).assign(label=train["label"][fold == f].to_numpy()) for f in range(k)], ignore_index=True)
    classes, want = bayes(meta, features(train, test), stack.features)
    assert np.allclose(np.vstack(got["probs"]), want) and got["predicted"].tolist() == predicted(classes, want)


def test_parameter_search_trains_every_point(nominal):
    pdf, df = nominal
    grid = [search.Parameter("smooth", 0.5, "I", 2), search.Parameter("top", 1, "A", 4, whole=True)]
    out = search.parameter_search(df, learners.NaiveBayes(ATTRS, "smooth", "top"), grid, folds=4).orderBy("point").collect()
    fold = fold_of(pdf, 4)
    rows = int((fold != 0).sum())
    points = list(itertools.product([0.5, float(rows)], [1.0, 2.0, 3.0, 4.0]))
    assert [(r["smooth"], r["top"]) for r in out] == points

    def gain(t, a):
        entropy = lambda x: -sum(p * math.log2(p) for p in x.value_counts(normalize=True))
        known = t.dropna(subset=[a])
        return entropy(known["label"]) - sum(len(g) / len(known) * entropy(g["label"]) for _, g in known.groupby(a))

    for r, (smooth, top) in zip(out, points):
        wrong = 0
        for f in range(4):
            train, test = pdf[fold != f], pdf[fold == f]
            kept = sorted(ATTRS, key=lambda a: (-round(gain(train, a), 9), a))[: int(top)]
            classes, probs = bayes(train, test, kept, smooth)
            wrong += sum(p != y for p, y in zip(predicted(classes, probs), test["label"]))
        assert r["error"] == pytest.approx(wrong / len(pdf))
    best = min(out, key=lambda r: (round(r["error"], 9), r["point"]))
    assert [r["point"] for r in out if r["best"]] == [best["point"]]
    learner, model = search.fit_best(df, lambda smooth, top: learners.NaiveBayes(ATTRS, smooth, int(top)), df.sparkSession.createDataFrame(out), grid)
    assert learner.smooth == best["smooth"] and model.count() > 0
    with pytest.raises(ValueError):
        search.parameter_search(df.limit(2), learners.NaiveBayes(ATTRS), grid, folds=4)
    with pytest.raises(ValueError):
        search.Parameter("p", 3, 1, 2).values(3, 10)


def test_bias_variance_any_learner(nominal):
    pdf, df = nominal
    votes = ensemble.bias_variance_votes(df, learners.NaiveBayes(["a", "c"]), iterations=6, pool=60)
    per = votes.groupBy("iter").agg(F.sum("w").alias("n")).collect()
    assert {r["iter"]: r["n"] for r in per} == {i: len(pdf) - 60 for i in range(1, 7)}
    with pytest.raises(ValueError):
        ensemble.bias_variance_votes(df.limit(50), learners.OneAttribute("a"), pool=40)


class Fixed:
    """An evaluator with given errors that records what it was asked."""

    def __init__(self, spark, errors):
        self.spark, self.table, self.asked = spark, errors, []

    def errors(self, subsets):
        self.asked.append(sorted(subsets))
        return self.spark.createDataFrame([(k, self.table(frozenset(s))) for k, s in subsets.items()], "subset_id string, error double")


@pytest.mark.parametrize("stale", [1, 2, 5])
def test_best_first_backtracks(spark, stale):
    """A trap: the best single attribute leads nowhere, the best pair lies below another one."""
    value = {frozenset(): 0.9, frozenset("a"): 0.3, frozenset("b"): 0.5, frozenset("c"): 0.6, frozenset("bc"): 0.1}

    def error(s):
        return value.get(s, 0.7)

    seen = Fixed(spark, error)
    out = {r["subset_id"]: r for r in search.best_first(seen, list("abcd"), stale=stale).collect()}
    flat = [k for asked in seen.asked for k in asked]
    assert len(flat) == len(set(flat)) == len(out)  # nothing is scored twice
    best = [k for k, r in out.items() if r["best"]]
    assert best == (["a"] if stale == 1 else ["b+c"])
    back = search.best_first(Fixed(spark, lambda s: 0.1 * abs(len(s) - 2) + (0.0 if "d" in s else 0.05)), list("abcd"), start="abcd", backward=True, stale=stale)
    assert [len(r["attrs"]) for r in back.filter("best").collect()] == [2]


def test_best_first_scores_by_any_evaluator(nominal):
    pdf, df = nominal
    out = {r["subset_id"]: r["error"] for r in search.best_first(search.Inconsistency(df, ATTRS), ATTRS, stale=9).collect()}
    assert len(out) == 8
    for key, error in out.items():
        names = [] if key == "(none)" else key.split("+")
        groups = pdf.fillna("?").groupby(names) if names else [((), pdf)]
        assert error == pytest.approx(1 - sum(g["label"].value_counts().max() for _, g in groups) / len(pdf))
    by_folds = search.FoldError(df, ATTRS, folds=4).errors({"ac": ["a", "c"]}).first()["error"]
    fold, wrong = fold_of(pdf, 4), 0
    for f in range(4):
        classes, probs = bayes(pdf[fold != f], pdf[fold == f], ["a", "c"])
        wrong += sum(p != y for p, y in zip(predicted(classes, probs), pdf["label"][fold == f]))
    assert by_folds == pytest.approx(wrong / len(pdf))


# -- densities -----------------------------------------------------------------


def test_full_density(spark):
    random = np.random.default_rng(0)
    mix = random.normal(size=(4, 4))
    x = random.normal(size=(300, 4)) @ mix.T + 2
    rows = [(int(i), x[i].tolist(), "k" if i % 3 else "m", float(1 + i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label string, w double")
    model = moments.full_gaussian(df, 4, "w")
    for r in model.collect():
        own = np.array([i % 3 > 0 if r["label"] == "k" else i % 3 == 0 for i in range(300)])
        w = np.array([1.0 + i % 2 for i in range(300)])[own]
        mean = (x[own] * w[:, None]).sum(axis=0) / w.sum()
        cov = ((x[own] - mean) * w[:, None]).T @ (x[own] - mean) / w.sum()
        low = np.zeros((4, 4))
        for i, line in enumerate(r["factor"]):
            low[i, : i + 1] = line
        assert np.allclose(r["mean"], mean) and np.allclose(low @ low.T, cov)
        points = [*x[:5].tolist(), [float("nan"), 0.0, 0.0, 0.0], None, [1.0, 2.0]]
        got = spark.createDataFrame([(p,) for p in points], "x array<double>").select(gaussian_logpdf_full(F.col("x"), F.lit(r["mean"]), F.array(*[F.array(*map(F.lit, line)) for line in r["factor"]])).alias("v")).collect()
        gap = x[:5] - mean
        want = -0.5 * (np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap) + np.linalg.slogdet(cov)[1] + 4 * np.log(2 * np.pi))
        assert np.allclose([g["v"] for g in got[:5]], want) and [g["v"] for g in got[5:]] == [LOG_ZERO] * 3
    flat = spark.createDataFrame([(0, [1.0, 1.0], "k"), (1, [2.0, 2.0], "k"), (2, [5.0, 5.0], "k")], "id long, x array<double>, label string")
    factor = moments.full_gaussian(flat, 2, floor=1e-4).first()["factor"]
    assert all(np.isfinite(v) for line in factor for v in line) and factor[1][1] > 0


def grown(x, y, lam=1.0, share=0.2, tol=1e-4, max_iter=4, floor=1e-4):
    """Discriminative growth in numpy."""
    names, n, d = sorted(set(y)), len(y), x.shape[1]
    prior = {c: (y == c).mean() for c in names}

    def sums(model):
        logs = np.stack([np.log(w * prior[c]) - 0.5 * (((x - m) ** 2 / v + np.log(v)).sum(axis=1) + d * np.log(2 * np.pi)) for c, _, w, m, v in model], axis=1)
        own = np.where(np.array([[c == t for c, *_ in model] for t in y]), logs, -1e30)
        total = lambda z: np.logaddexp.reduce(z, axis=1)
        o, g = np.exp(own - total(own)[:, None]), np.exp(logs - total(logs)[:, None])
        gap = o - g
        return gap.sum(axis=0), g.sum(axis=0), gap.T @ x, gap.T @ x**2, (total(own) - total(logs)).mean()

    def update(model, s, smooth):
        surplus, occ, d1, d2, _ = s
        out = []
        for i, (c, k, w, m, v) in enumerate(model):
            dd = max(smooth * occ[i], 1.0)
            mean = (d1[i] + dd * m) / (surplus[i] + dd)
            out.append([c, k, max(surplus[i] + dd * w, 1e-10), mean, np.maximum((d2[i] + dd * (v + m * m)) / (surplus[i] + dd) - mean**2, floor)])
        sums_ = {c: sum(r[2] for r in out if r[0] == c) for c in names}
        return [(c, k, w / sums_[c], m, v) for c, k, w, m, v in out]

    def fit(model, max_iter):
        smooth, best, old, calm, at = 1.2, None, None, 0, 0
        for number in range(max_iter):
            s = sums(model)
            if best is None or s[4] > best[1][4]:
                best, at = (model, s), number
            change = np.inf if old is None else s[4] - old
            calm = calm + 1 if abs(change) < tol else 0
            if calm and change < 0:
                smooth *= 1.2
            if calm >= 3 or number - at >= 10:
                break
            old, model = s[4], update(model, s, smooth)
        return best

    best = fit([(c, 0, 1.0, x[y == c].mean(axis=0), np.maximum(x[y == c].var(axis=0), floor)) for c in names], 100)
    value = lambda b: b[1][4] * n - 0.5 * lam * len(b[0]) * (2 * d + 1) * math.log(n)
    while True:
        model, surplus = best[0], best[1][0]
        out = []
        for c in names:
            last = max(k for t, k, *_ in model if t == c)
            for (t, k, w, m, v), s in sorted(zip(model, surplus), key=lambda z: z[0][1]):
                if t != c:
                    continue
                if s > share * max(surplus):
                    last += 1
                    out += [(c, k, w / 2, m - 0.2 * np.sqrt(v), v), (c, last, w / 2, m + 0.2 * np.sqrt(v), v)]
                else:
                    out.append((c, k, w, m, v))
        now = fit(out, max_iter)
        if value(now) - value(best) < tol:
            return best[0]
        best = now


def test_discriminative_growth_equals_numpy(spark):
    random = np.random.default_rng(3)
    x, y = [], []
    for c, places in {"p": [(-4, 0), (4, 0)], "q": [(0, 0), (9, 0)]}.items():
        for place in places:
            x.append(random.normal(size=(60, 2)) * 0.8 + place)
            y += [c] * 60
    x, y = np.vstack(x), np.array(y)
    df = spark.createDataFrame([(p.tolist(), str(c)) for p, c in zip(x, y)] + [([0.0, 0.0], None)], "x array<double>, label string")
    got = sorted((r["label"], r["comp"], r["weight"], r["mean"], r["var"]) for r in mixture.gmm_grow_discriminative(df, 2, max_iter=12).collect())
    want = sorted(grown(x, y, max_iter=12), key=lambda r: r[:2])
    assert len(got) == len(want) > 2
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and np.allclose(g[2], w[2], atol=1e-6) and np.allclose(g[3], w[3], atol=1e-5) and np.allclose(g[4], w[4], atol=1e-5)
