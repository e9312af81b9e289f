"""Registered queries run to the stop rule of their operator."""

import inspect

import numpy as np
import pytest

FOLDER = "/root/testdata/sf0.001"
LOOPS = {
    "gmm_fit": ("mixture", "gmm_fit"), "gmm_select_bic": ("mixture", "gmm_select_bic"), "kmeans_codebook": ("cluster", "kmeans_codebook"),
    "cluster_cv_loglik": ("cluster", "cluster_cv_loglik"), "segmental_kmeans": ("sequences", "segmental_kmeans"), "baum_welch_fit": ("sequences", "baum_welch_fit"),
    "grow_mixtures": ("sequences", "grow_mixtures"), "subset_eval_cv": ("search", "subset_eval_cv"), "forward_race": ("search", "hill_race"),
    "backward_race": ("search", "hill_race"), "rank_race": ("search", "rank_race"), "schemata_race": ("search", "schemata_race"), "doubling_search": ("search", "doubling_search"),
}
STOPS = {"max_iter", "max_k", "rounds", "repeats", "trials", "attempts", "limit"}


class Called(Exception):
    pass


@pytest.mark.parametrize("name", LOOPS)
def test_no_loop_is_cut(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from strandlab.operators import cluster, mixture, sequences
    from strandlab.plans import search

    module, attribute = LOOPS[name]
    module = {"cluster": cluster, "mixture": mixture, "sequences": sequences, "search": search}[module]
    sign = inspect.signature(getattr(module, attribute))
    stops = STOPS | ({"folds"} if name.endswith("race") else set())

    def called(*args, **kwargs):
        given = sign.bind(*args, **kwargs).arguments
        raise Called({k: v for k, v in given.items() if k in stops and v != sign.parameters[k].default})

    monkeypatch.setattr(module, attribute, called)
    queries = entry.queries() if callable(entry.queries) else entry.queries
    with pytest.raises(Called) as seen:
        queries[name](spark, FOLDER)
    assert seen.value.args[0] == {}


def test_codebook_returns_all_dimensions(spark):
    import __spark_entry__ as entry

    queries = entry.queries() if callable(entry.queries) else entry.queries
    assert queries["kmeans_codebook"](spark, FOLDER).columns == ["label", "code", *(f"c{i + 1}" for i in range(64))]


def grown(x, floor, tol=1e-4, max_iter=100):
    """Mixture of one class by the rule of ``gmm_select_bic``: split the heaviest, EM, stop when BIC falls."""

    def logs(model):
        w, m, v = model
        return np.log(w) - 0.5 * (((x[:, None] - m) ** 2 / v + np.log(v)).sum(axis=2) + x.shape[1] * np.log(2 * np.pi))

    def bic(model):
        return np.logaddexp.reduce(logs(model), axis=1).sum() - 0.5 * len(model[0]) * (2 * x.shape[1] + 1) * np.log(len(x))

    model = (np.ones(1), x.mean(axis=0)[None], np.maximum(x.var(axis=0), floor)[None])
    while True:
        w, m, v = model
        j = int(np.argmax(np.round(w, 12)))
        step = 0.2 * np.sqrt(v[j])
        w, v = np.append(w, w[j] / 2), np.vstack([v, v[j]])
        m = np.vstack([m, m[j] + step])
        w[j], m[j] = w[j] / 2, m[j] - step
        last = None
        for _ in range(max_iter):
            lp = logs((w, m, v))
            total = np.logaddexp.reduce(lp, axis=1)
            r = np.exp(lp - total[:, None])
            occ = r.sum(axis=0)
            w, m = occ / len(x), r.T @ x / occ[:, None]
            v = np.maximum(r.T @ x**2 / occ[:, None] - m**2, floor)
            if last is not None and abs(total.mean() - last) < tol:
                break
            last = total.mean()
        if bic((w, m, v)) <= bic(model):
            return model
        model = (w, m, v)


def test_bic_grows_past_three(spark, tmp_path):
    import __spark_entry__ as entry
    from strandlab.operators.moments import VAR_FLOOR

    random = np.random.default_rng(7)
    centers = np.array([[0.0, 0.0], [40.0, 0.1], [10.0, 0.4], [60.0, 0.5]])
    rows = [(float(q), float(d), "A") for c, n in zip(centers, (140, 110, 90, 60)) for q, d in c + random.normal(size=(n, 2)) * (3.0, 0.01)]
    spark.createDataFrame(rows, "l_quantity double, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    w, m, _ = grown(np.array([(q / 10, d * 100) for q, d, _ in rows]), VAR_FLOOR)
    assert len(w) > 3
    queries = entry.queries() if callable(entry.queries) else entry.queries
    got = sorted(queries["gmm_select_bic"](spark, str(tmp_path)).collect(), key=lambda r: r["comp"])
    assert len(got) == len(w)
    assert np.allclose([[r["weight"], r["m1"], r["m2"]] for r in got], np.column_stack([w, m]), atol=2e-3)


def test_split_is_chosen_among_all_kinds(spark, tmp_path):
    """The class follows the date: a threshold wins over every nominal split, checked by trying all cuts."""
    import datetime

    import __spark_entry__ as entry

    random = np.random.default_rng(2)
    rows = []
    for i in range(300):
        day = int(random.integers(0, 2000))
        rows.append((i, "F" if day < 1234 else "O", float(random.integers(1000, 400000)), datetime.date(1992, 1, 1) + datetime.timedelta(day), f"{i % 5}-P"))
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    queries = entry.queries() if callable(entry.queries) else entry.queries
    got = queries["select_split_any"](spark, str(tmp_path)).collect()
    days = sorted({(r[3] - datetime.date(1970, 1, 1)).days for r in rows})
    last = max((r[3] - datetime.date(1970, 1, 1)).days for r in rows if r[1] == "F")

    def entropy(labels):
        p = np.unique(labels, return_counts=True)[1] / len(labels)
        return -(p * np.log2(p)).sum()

    label = np.array([r[1] for r in rows])
    low = np.array([(r[3] - datetime.date(1970, 1, 1)).days <= last for r in rows])
    cuts = sum(15 <= sum((r[3] - datetime.date(1970, 1, 1)).days <= d for r in rows) <= 285 for d in days)
    gain = entropy(label) - np.log2(cuts) / 300
    assert [(r["attr"], r["kind"], float(r["point"])) for r in got] == [("placed", "numeric", float(last))]
    assert abs(got[0]["gain"] - gain) < 1e-6 and abs(got[0]["gain_ratio"] - gain / entropy(low)) < 1e-6
