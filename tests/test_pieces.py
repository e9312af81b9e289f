"""Operators give the same result however a long key is cut into pieces."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlab.operators import buckets, counts, neighbors, sequences, series
from strandlab.operators.ordering import dense_index, join_sized, running_totals, seeded_rank, split_keys
from strandlab.functions.exprs import seeded_hash


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows; order values repeat."""
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"key": np.where(rng.random(n) < 0.8, 1, rng.integers(2, 6, n)), "o": rng.integers(0, 90, n), "id": range(n), "v": rng.random(n).round(3)})
    pdf["label"] = np.where(pdf["v"] > 0.5, "a", "b")
    return pdf, spark.createDataFrame(pdf).repartition(7)


def _pd(df, *sort):
    return df.toPandas().sort_values(list(sort)).reset_index(drop=True)


def test_split_keys_cuts_only_long_keys(skewed):
    _, df = skewed
    cut, long = split_keys(df, ["key"], ["o", "id"], 40)
    assert long
    per = cut.groupBy("key").agg(F.countDistinct("_piece").alias("n")).toPandas().set_index("key")["n"]
    assert per[1] > 5 and (per.drop(1) == 1).all()
    assert cut.count() == 600


def test_equal_rows_are_parted(spark):
    """One key of 1,000 equal rows and one short key."""
    df = spark.createDataFrame([(1, 7.0)] * 1000 + [(2, 1.0)] * 3, "key long, o double").repartition(5)
    pieces, _ = split_keys(df, ["key"], ["o"], 50)
    per = [r["count"] for r in pieces.filter("key = 1").groupBy("_piece").count().collect()]
    assert len(per) > 12 and max(per) < 150 and sum(per) == 1000
    assert pieces.columns == ["key", "o", "_piece"]
    index = sorted((r["key"], r["t"]) for r in dense_index(df, ["key"], ["o"], piece_rows=50).collect())
    assert index == [(1, i) for i in range(1000)] + [(2, i) for i in range(3)]


def test_sequences_meet_by_parts(spark):
    """One sequence of a third of all frames: the joins deal its rows, and nothing changes."""
    rng = np.random.default_rng(3)
    sizes = {0: 200, **{i: int(rng.integers(1, 30)) for i in range(1, 30)}}
    rows = [(s, t, [float(rng.integers(-4, 9))], "ab"[s % 2]) for s, n in sizes.items() for t in range(n)]
    frames = spark.createDataFrame(rows, "seq_id long, t long, x array<double>, label string").repartition(6)
    lens = frames.groupBy("seq_id").agg(F.count(F.lit(1)).alias("len"))
    assert frames.count() == join_sized(frames, lens, ["seq_id"], "len", ["t"], 20).count()
    signal = frames.select(F.col("seq_id").alias("key"), "t", F.col("x")[0].alias("v"))
    target = lens.select("seq_id", (F.col("len") + F.pmod("seq_id", F.lit(5)) - 2).alias("target_len"))
    for make in (
        lambda k: series.min_frames(frames, 9, **k), lambda k: series.uniform_segmentation(frames, 4, **k), lambda k: series.center_per_sequence(frames, 1, **k),
        lambda k: series.frame_energy(frames, -1.0, 30.0, **k), lambda k: series.trim_nonpositive(signal, **k), lambda k: series.align_and_concat(frames, frames, target, **k),
    ):
        plain, dealt = make({}), make({"piece_rows": 11})
        assert plain.columns == dealt.columns and sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect())) != []
    assert {r["seq_id"] for r in series.min_frames(frames, 9, 11).select("seq_id").distinct().collect()} == {s for s, n in sizes.items() if n >= 9}


def test_dense_index_and_running_totals(skewed):
    pdf, df = skewed
    got = _pd(dense_index(df, ["key"], ["o", "id"], piece_rows=40), "key", "t")
    want = pdf.sort_values(["key", "o", "id"]).assign(t=lambda d: d.groupby("key").cumcount())
    assert got["id"].tolist() == want["id"].tolist() and got["t"].tolist() == want["t"].tolist()
    tot = _pd(running_totals(df, ["key"], ["o", "id"], {"s": F.col("v")}, 40), "key", "o", "id")
    assert np.allclose(tot["s"], pdf.sort_values(["key", "o", "id"]).groupby("key")["v"].cumsum())


@pytest.mark.parametrize("n", [-3, 2])
def test_translate_series(skewed, n):
    pdf, df = skewed
    got = _pd(series.translate_series(df, ["key"], ["o", "id"], ["v"], n, piece_rows=25), "id")
    want = pdf.sort_values(["key", "o", "id"]).copy()
    want["v"] = want.groupby("key")["v"].shift(-n)
    want = want.dropna(subset=["v"]).sort_values("id")
    assert got["id"].tolist() == want["id"].tolist() and np.allclose(got["v"], want["v"])


def test_runs_round_trip(spark, skewed):
    _, df = skewed
    frames = dense_index(df, ["key"], ["o", "id"]).select(F.col("key").alias("seq_id"), "t", "label")
    one = _pd(series.run_lengths(frames, "label"), "seq_id", "run")
    cut = _pd(series.run_lengths(frames, "label", piece_rows=10), "seq_id", "run")
    pd.testing.assert_frame_equal(one, cut[one.columns])
    coded = series.run_length_encode(frames, "label", runs_per_part=7)
    assert coded.filter("part > 0").count() > 0
    back = _pd(series.run_length_decode(coded, piece_rows=15), "seq_id", "t")
    assert back["state"].tolist() == _pd(frames, "seq_id", "t")["label"].tolist()


def test_deltas_on_pieces(skewed):
    _, df = skewed
    frames = dense_index(df, ["key"], ["o", "id"]).select(F.col("key").alias("seq_id"), "t", F.array("v").alias("x"))
    a = _pd(series.delta_features(frames), "seq_id", "t")
    b = _pd(series.delta_features(frames, piece_rows=6), "seq_id", "t")
    assert np.allclose([v[0] for v in a["accel"]], [v[0] for v in b["accel"]])


def test_split_numeric_on_pieces(skewed):
    _, df = skewed
    a = counts.split_numeric(df, ["v", "o"]).toPandas()
    b = counts.split_numeric(df, ["v", "o"], piece_rows=50).toPandas()
    pd.testing.assert_frame_equal(a.sort_values("attr").reset_index(drop=True), b.sort_values("attr").reset_index(drop=True)[a.columns])


def test_one_rule_numeric_on_pieces(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=900).round(2), "label": rng.choice(list("abc"), 900)})
    pdf.loc[::50, "x"] = None
    df = spark.createDataFrame(pdf)
    a = _pd(buckets.one_rule_numeric(df, ["x"], min_bucket=6), "bucket")
    b = _pd(buckets.one_rule_numeric(df, ["x"], min_bucket=6, piece_rows=60), "bucket")
    pd.testing.assert_frame_equal(a, b)
    assert a["n"].sum() == 900 and (a["predicted"].iloc[1:-1].to_numpy() != a["predicted"].iloc[2:].to_numpy()).all()


def _greedy_buckets(pdf, least):
    """Buckets one value after another, as the definition has them."""
    classes, out, i = sorted(pdf["label"].unique()), [], 0
    values = [(v, {c: int((g["label"] == c).sum()) for c in classes}) for v, g in pdf.dropna(subset=["x"]).groupby("x")]
    while i < len(values):
        counts, low, full = dict.fromkeys(classes, 0), values[i][0], None
        while i < len(values) and (full is None or not any(n and c != full for c, n in values[i][1].items())):
            for c, n in values[i][1].items():
                counts[c] += n
            high, i = values[i][0], i + 1
            if full is None and max(counts.values()) >= least:
                full = min(classes, key=lambda c: (-counts[c], c))
        top = max(counts.values())
        cls = out[-1][2] if out and counts[out[-1][2]] == top else min(c for c in classes if counts[c] == top)
        if out and out[-1][2] == cls:
            out[-1] = (out[-1][0], high, cls, out[-1][3] + top, out[-1][4] + sum(counts.values()))
        else:
            out.append((low, high, cls, top, sum(counts.values())))
    return out


@pytest.mark.parametrize("classes, least, pieces", [("ab", 3, 7), ("abc", 6, 40), ("abcdefghij", 2, 25), ("ab", 50, 30)])
def test_one_rule_numeric_equals_greedy(spark, classes, least, pieces):
    """Repeated values, long runs of one class over several pieces, ties, and an open last bucket."""
    rng = np.random.default_rng(len(classes) + least)
    x = rng.integers(0, 220, 500).astype(float)
    label = rng.choice(list(classes), 500)
    label[(x > 60) & (x < 130)] = classes[1]
    pdf = pd.DataFrame({"x": x, "label": label})
    want = _greedy_buckets(pdf, least)
    df = spark.createDataFrame(pdf).repartition(4)
    for piece_rows in (pieces, 1_000_000):
        out = _pd(buckets.one_rule_numeric(df, ["x"], min_bucket=least, piece_rows=piece_rows), "bucket")
        assert list(zip(out["low"], out["high"], out["predicted"], out["correct"], out["n"])) == want
        assert out["upper"].iloc[:-1].tolist() == [(a[1] + b[0]) / 2 for a, b in zip(want, want[1:])]


def test_seeded_rank_is_a_permutation(skewed):
    _, df = skewed
    h = df.withColumn("h", seeded_hash(F.col("id"), 3))
    got = _pd(seeded_rank(h, ["label"], "h", "id", prefix=2), "label", "rank")
    for _, g in got.groupby("label"):
        assert g["rank"].tolist() == list(range(1, len(g) + 1))
        assert g["h"].is_monotonic_increasing


def _brute_neighbors(train, query, k):
    lo, hi = train["x"].min(), train["x"].max()
    out = set()
    for _, q in query.iterrows():
        a = (q["x"] - lo) / (hi - lo)
        ds = []
        for _, t in train.iterrows():
            b = (t["x"] - lo) / (hi - lo)
            if np.isnan(a) and np.isnan(b):
                dx = 1.0
            elif np.isnan(b):
                dx = max(a, 1 - a)
            elif np.isnan(a):
                dx = max(b, 1 - b)
            else:
                dx = a - b
            dc = 0.0 if isinstance(q["c"], str) and q["c"] == t["c"] else 1.0
            ds.append((round(float(np.sqrt((dx * dx + dc) / 2)), 9), t["id"]))
        kth = sorted(d for d, _ in ds)[k - 1]
        out |= {(q["id"], i) for d, i in ds if d <= kth}
    return out


def test_knn_blocks_copies_and_ties(spark):
    rng = np.random.default_rng(8)
    train = pd.DataFrame({"id": range(120), "x": rng.integers(0, 12, 120).astype(float), "c": rng.choice(["p", "q", "r"], 120), "label": rng.choice(["u", "v"], 120)})
    train.loc[:40, ["x", "c"]] = [5.0, "p"]  # a third of the rows are copies
    train.loc[100:105, "x"] = np.nan
    train.loc[106:108, "c"] = None
    query = train.sample(30, random_state=1).assign(id=lambda d: d["id"] + 1000)
    kinds = "id long, x double, c string, label string"
    clean = lambda p: [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in p.itertuples(index=False)]
    t, q = spark.createDataFrame(clean(train), kinds), spark.createDataFrame(clean(query), kinds)
    near = neighbors.knn_topk(q, t, 4, ["x"], ["c"], rows=17)
    got = {(r["query"], r["neighbor"]) for r in neighbors.with_train_ids(near, t, ["x"], ["c"]).collect()}
    assert got == _brute_neighbors(train, query, 4)
    whole = neighbors.knn_topk(q, t, 4, ["x"], ["c"])
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, whole.collect()))


def test_one_rule_numeric_holds_few_values_in_python(spark, monkeypatch):
    sizes = []
    whole = buckets.map_whole_groups

    def seen(df, keys, *args):
        sizes.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return whole(df, keys, *args)

    monkeypatch.setattr(buckets, "map_whole_groups", seen)
    df = spark.range(150_000).selectExpr("cast(id as double) as x", "cast(id div 40000 as string) as label")
    out = buckets.one_rule_numeric(df, ["x"]).orderBy("bucket").collect()
    assert [(r["low"], r["predicted"], r["n"]) for r in out] == [(i * 40_000.0, str(i), min(40_000.0, 150_000.0 - i * 40_000)) for i in range(4)]
    assert max(sizes) < 70_000


def test_cells_prune_and_lose_nothing(spark):
    """Clustered rows: every query has its exact neighbours, and far fewer pairs are measured than there are."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 3)) * 20
    x = np.vstack([c + rng.normal(size=(50, 3)) for c in centre])
    q = np.vstack([x[::7] + 0.1, rng.normal(size=(6, 3)) * 60])
    train = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id long, x array<double>, label string")
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    dist = np.round(np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    for cells, rows in ((24, 16), (7, 1000), (1, 40)):
        near, work = neighbors.candidates(query, train, 5, vector="x", rows=rows, cells=cells)
        got = neighbors.knn_topk(query, train, 5, vector="x", rows=rows, cells=cells)
        found = {}
        for r in got.collect():
            found.setdefault(r["query"], []).append(r["distance"])
        assert {i: sorted(v) for i, v in found.items()} == {i: sorted(d[d <= np.sort(d)[4]]) for i, d in enumerate(dist)}
        assert near.count() and (work < 0.35 * dist.size if cells == 24 else work <= dist.size)
    few = neighbors.knn_topk(query, train.limit(3), 5, vector="x", cells=3)  # fewer rows than neighbours asked for
    assert few.count() == 3 * len(q)
    assert neighbors.knn_topk(query, train.limit(0), 5, vector="x").count() == 0


def test_cells_with_missing_values_and_self_left_out(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 11 == 0 else float(rng.integers(0, 40)), None if i % 13 == 0 else str(rng.integers(0, 4)), "uv"[i % 2]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x double, c string, label string")
    one = neighbors.knn_topk(df, df, 3, ["x"], ["c"], leave_self_out=True, cells=1)
    many = neighbors.knn_topk(df, df, 3, ["x"], ["c"], leave_self_out=True, cells=20, rows=8)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_boxes_prune_rows_with_gaps(spark):
    """Queries without a name or a number meet few rows too, and every neighbour of brute force is found."""
    rng = np.random.default_rng(8)
    n = 1500
    rows = [(i, None if i % 17 == 0 else float(np.round(rng.random(), 4)), None if i % 19 == 0 else str(rng.integers(0, 6)), "uv"[i % 2]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, c string, label string")
    near, work = neighbors.candidates(df, df, 4, ["x"], ["c"], leave_self_out=True, cells=100, rows=16)
    got = {}
    for r in neighbors.knn_topk(df, df, 4, ["x"], ["c"], leave_self_out=True, cells=100, rows=16).collect():
        got.setdefault(r["query"], []).extend([r["distance"]] * int(r["w"]))
    x = np.array([np.nan if r[1] is None else r[1] for r in rows])
    x = (x - np.nanmin(x)) / (np.nanmax(x) - np.nanmin(x))
    a, b = x[:, None], x[None]
    gap = np.where(np.isnan(a) & np.isnan(b), 1, np.where(np.isnan(a), np.maximum(b, 1 - b), np.where(np.isnan(b), np.maximum(a, 1 - a), a - b)))
    name = np.array([r[2] for r in rows], dtype=object)
    other = (name[:, None] != name[None]) | np.equal(name, None)[:, None] | np.equal(name, None)[None]
    dist = np.round(np.sqrt((gap**2 + other) / 2), 9)
    np.fill_diagonal(dist, np.inf)
    kth = np.sort(dist, axis=1)[:, 3]
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(d[d <= t]) for i, (d, t) in enumerate(zip(dist, kth))}
    assert work < 0.1 * n * n


def test_vectors_without_structure_meet_in_large_blocks(spark, monkeypatch):
    from strandlab.operators import cells as cell_module

    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(400, 24)), rng.normal(size=(60, 24))
    train = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id long, x array<double>, label string")
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    met = []
    pair = cell_module.pair_blocks
    monkeypatch.setattr(cell_module, "pair_blocks", lambda *a: met.append(1) or pair(*a))
    found = {}
    for r in neighbors.knn_topk(query, train, 5, vector="x", rows=32).collect():
        found.setdefault(r["query"], []).append(r["distance"])
    dist = np.round(np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(d[d <= np.sort(d)[4]]) for i, d in enumerate(dist)}
    assert met


def test_folds_are_scaled_by_the_others(spark):
    rows = [(i, float(i if i != 9 else 1000), str(i % 2), i % 3, "uv"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x double, c string, fold int, label string")
    got = {(r["k"], r["fold"]): r["error"] for r in neighbors.knn_cv_errors(df, 2, ["x"], ["c"]).collect()}
    for f in range(3):
        t, q = [r for r in rows if r[3] != f], [r for r in rows if r[3] == f]
        lo, hi = min(r[1] for r in t), max(r[1] for r in t)
        for k in (1, 2):
            wrong = 0
            for a in q:
                d = sorted((round(float(np.sqrt((((a[1] - b[1]) / (hi - lo)) ** 2 + (a[2] != b[2])) / 2)), 9), b[4]) for b in t)
                votes = [y for e, y in d if e <= d[k - 1][0]]
                wrong += min(set(votes), key=lambda y: (-votes.count(y), y)) != a[4]
            assert got[k, f] == pytest.approx(wrong / len(q))


def test_kernel_blocks(spark):
    rng = np.random.default_rng(2)
    q, s = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    alpha = rng.normal(size=30)
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    sd = spark.createDataFrame([("m", v.tolist(), float(a)) for v, a in zip(s, alpha)], "clf string, x array<double>, alpha double")
    got = neighbors.kernel_score(qd, sd, gamma=0.3, bias=0.1, rows=11).orderBy("row_id").toPandas()
    want = np.exp(-0.3 * ((q[:, None] - s[None]) ** 2).sum(2)) @ alpha + 0.1
    assert np.allclose(got["score"], want)


def test_kernel_rows_are_shared_by_machines_and_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    q, s = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    alpha = rng.normal(size=(30, 4))
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    sd = spark.createDataFrame([(str(c), v.tolist(), float(a[c])) for v, a in zip(s, alpha) for c in range(4)], "clf string, x array<double>, alpha double")
    sizes = []
    pair = neighbors.pair_blocks
    monkeypatch.setattr(neighbors, "pair_blocks", lambda left, right, *a: sizes.append(right.count()) or pair(left, right, *a))
    got = {(r["row_id"], r["clf"], r["gamma"]): r["score"] for r in neighbors.kernel_scores(qd, sd, [0.3, 2.0], bias=0.1, rows=11).collect()}
    d2 = ((q[:, None] - s[None]) ** 2).sum(2)
    for gamma in (0.3, 2.0):
        want = np.exp(-gamma * d2) @ alpha + 0.1
        assert all(got[i, str(c), gamma] == pytest.approx(want[i, c]) for i in range(40) for c in range(4))
    assert sizes == [30]  # one row for each support vector, not one for each machine


# -- sequence models on pieces ----------------------------------------------------


@pytest.fixture(scope="module")
def hmm(spark):
    rng = np.random.default_rng(11)
    rows = []
    for seq in range(12):
        state = 0
        for t in range(int(rng.integers(3, 60))):
            rows.append((seq, t, [float(rng.normal([0.0, 2.0, 4.0][state], 1.0))], "m" if seq % 2 else "k"))
            state = min(2, state + int(rng.random() < 0.15))
    frames = spark.createDataFrame(rows, "seq_id long, t long, x array<double>, label string")
    return frames, *sequences.initial_models(frames, 3, 1)


def test_viterbi_pieces(hmm):
    frames, t, g = hmm
    a = _pd(sequences.viterbi_score(frames, t, g), "seq_id", "model")
    b = _pd(sequences.viterbi_score(frames, t, g, piece=4, fan=2), "seq_id", "model")
    assert np.allclose(a["total"].astype(float), b["total"].astype(float), equal_nan=True)
    p = _pd(sequences.viterbi_path(frames, t, g), "seq_id", "t")
    q = _pd(sequences.viterbi_path(frames, t, g, piece=4, fan=2), "seq_id", "t")
    assert p["state"].tolist() == q["state"].tolist()


def test_baum_welch_pieces(hmm):
    frames, t, g = hmm
    _, _, a = sequences.baum_welch_step(frames, t, g)
    _, _, b = sequences.baum_welch_step(frames, t, g, piece=4, fan=3)
    keys = ["kind", "model", "a", "b"]
    x, y = _pd(a, *keys), _pd(b, *keys)
    assert x[keys].values.tolist() == y[keys].values.tolist()
    assert np.allclose(x["occ"], y["occ"], atol=1e-6)
    for p, q in zip(x["s1"], y["s1"]):
        assert (p is None and q is None) or np.allclose(p, q, atol=1e-6)


@pytest.mark.parametrize("kind", ["date", "string", "decimal(10,2)", "timestamp"])
def test_order_columns_of_any_type(skewed, kind):
    pdf, df = skewed
    typed = df.withColumn("o", F.date_add(F.lit("2020-01-01").cast("date"), F.col("o").cast("int")) if kind in ("date", "timestamp") else F.lpad(F.col("o").cast("string"), 3, "0")).withColumn("o", F.col("o").cast(kind))
    cut, long = split_keys(typed, ["key"], ["o", "id"], 40)
    assert long and cut.filter("key = 1").select("_piece").distinct().count() > 5
    short = _pd(dense_index(typed, ["key"], ["o", "id"]), "key", "t")
    assert _pd(dense_index(typed, ["key"], ["o", "id"], piece_rows=40), "key", "t")["id"].tolist() == short["id"].tolist()


def test_tied_rows_are_cut_as_well(spark):
    rows = spark.createDataFrame([(1, 7, i) for i in range(200)], "key int, o int, id int")
    pieces = split_keys(rows, ["key"], ["o"], 20)[0].groupBy("_piece").count().toPandas()["count"]
    assert len(pieces) > 5 and pieces.max() < 120
    index = dense_index(rows, ["key"], ["o"], piece_rows=20)
    assert sorted(r["t"] for r in index.collect()) == list(range(200))


def test_impossible_sequences_count_alike_long_and_short(spark):
    t = spark.createDataFrame([("m", 0, 1, 0.0), ("m", 1, 2, 0.0), ("m", 2, 3, 0.0)], "model string, i int, j int, logp double")
    g = spark.createDataFrame([("m", s, 0, 0.0, [float(s)], [1.0]) for s in (1, 2)], "model string, state int, comp int, logw double, mean array<double>, var array<double>")
    frames = spark.createDataFrame([(1, i, [1.0], "m") for i in range(2)] + [(2, i, [1.0], "m") for i in range(9)], "seq_id long, t long, x array<double>, label string")
    for piece in (2048, 4):
        stats = sequences.baum_welch_step(frames, t, g, piece=piece, fan=2)[2]
        assert sequences.mean_loglik(stats)[1:] == (1, 1)


def test_unknown_transcripts_count_as_skipped(spark):
    t = spark.createDataFrame([("m", 0, 1, 0.0), ("m", 1, 1, -0.7), ("m", 1, 2, -0.7)], "model string, i int, j int, logp double")
    g = spark.createDataFrame([("m", 1, 0, 0.0, [0.0], [1.0])], "model string, state int, comp int, logw double, mean array<double>, var array<double>")
    frames = spark.createDataFrame([(s, i, [0.1 * i]) for s in (1, 2, 3, 4) for i in range(4)], "seq_id long, t long, x array<double>")
    words = spark.createDataFrame([(1, 0, "m"), (2, 0, "m"), (2, 1, "?"), (3, 0, None)], "seq_id long, pos int, label string")
    assert sequences.mean_loglik(sequences.embedded_step(frames, words, t, g)[2])[1:] == (1, 3)
