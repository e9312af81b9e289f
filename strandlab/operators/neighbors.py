"""Exact nearest neighbours over mixed attributes, and kernel scoring.

Pairs of rows are never written: training rows lie in cells, a query visits the cells that can hold one of its nearest
rows (``cells``, ``boxes``), each visit keeps the nearest rows only, and the visits are merged per query.
Equal training rows are counted first, so a large group of copies is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.operators.blocks import BLOCK_ROWS, pair_blocks
from strandlab.operators.boxes import MAX_LEAVES
from strandlab.operators.cells import DENSE_ROWS, MAX_PIVOTS, BoxCells, PivotCells, nearest
from strandlab.operators.prep import fit_minmax, minmax_expr
from strandlab.session import cut

BLOCK_PAIRS = 1_048_576  # pairs measured at once
KERNEL_STEP = 1_024  # rows of either side whose kernel values are held at once
DIGITS = 9  # distances equal to this many digits are ties


def _scaled(df: DataFrame, stats: DataFrame, numeric: Sequence[str]) -> DataFrame:
    out = df.join(F.broadcast(stats.limit(1))) if numeric else df
    drop = [f"{c}__{s}" for c in numeric for s in ("lo", "hi")]
    return out.withColumns(
        {c: minmax_expr(F.col(c).cast("double"), F.col(f"{c}__lo"), F.col(f"{c}__hi")) for c in numeric}
    ).drop(*drop)


def _signature(numeric: Sequence[str], nominal: Sequence[str]):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [*numeric, *nominal]]
    return F.md5(F.concat_ws("\u0001", *parts))


def _named(df: DataFrame, nominal: Sequence[str]) -> DataFrame:
    """Nominal columns as strings; not-a-number is missing."""
    kinds = dict(df.dtypes)
    known = {c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c) for c in nominal}
    return df.withColumns({c: v.cast("string") for c, v in known.items()})


def _mixed_squares(q: pd.DataFrame, t: pd.DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> np.ndarray:
    """Sums of squares of two blocks: nominal 0/1, missing 1, numbers on [0, 1]; a distance is the root of their mean."""
    total = np.zeros((len(q), len(t)))
    for c in numeric:
        a, b = q[c].to_numpy(float)[:, None], t[c].to_numpy(float)[None, :]
        d = a - b
        if np.isnan(a).any() or np.isnan(b).any():
            one_a, one_b = np.maximum(a, 1 - a), np.maximum(b, 1 - b)
            d = np.where(np.isnan(a) & np.isnan(b), 1.0, np.where(np.isnan(b), one_a, np.where(np.isnan(a), one_b, d)))
        d *= d
        total += d
    for c in nominal:
        codes, _ = pd.factorize(pd.concat([q[c], t[c]], ignore_index=True))
        a, b = codes[: len(q)][:, None], codes[len(q) :][None, :]
        total += (a != b) | (a < 0)
    return total


def near_mixed(
    q: pd.DataFrame, t: pd.DataFrame, numeric: Sequence[str], nominal: Sequence[str], k: int, bound: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) with their distance that hold the ``k`` nearest rows of every query within its bound.

    An entry stands for at least one row, so this keeps every row that can be among the k nearest, ties included; the merge
    cuts the rest.
    """
    parts = max(1, len(numeric) + len(nominal))
    squares = _mixed_squares(q, t, numeric, nominal)
    if squares.shape[1] > k:
        kth = np.partition(squares, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(squares <= (((np.sqrt(kth / parts) + 2e-9) ** 2) * parts + 1e-15)[:, None])
    else:
        i, j = np.nonzero(np.isfinite(squares))
    dist = np.round(np.sqrt(squares[i, j] / parts), DIGITS)
    ok = (dist <= bound[i]) & np.isfinite(dist)
    return i[ok], j[ok], dist[ok]


def _merged(i: np.ndarray, j: np.ndarray, dist: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with one query, distance and label (``labels`` of the training rows) as one, with their weights added up."""
    order = np.lexsort((labels[j], dist, i))
    i, j, dist, weight = (v[order] for v in (i, j, dist, weight))
    same = (i[1:] == i[:-1]) & (dist[1:] == dist[:-1]) & (labels[j[1:]] == labels[j[:-1]])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), dtype=bool), ~same]))
    return i[first], j[first], dist[first], np.add.reduceat(weight, first) if len(first) else weight


def vector_distance(q: pd.DataFrame, t: pd.DataFrame) -> np.ndarray:
    a, b = np.vstack(q["x"].to_numpy()), np.vstack(t["x"].to_numpy())
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 256):  # bounded scratch memory
        out[i : i + 256] = ((a[i : i + 256, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    return np.round(np.sqrt(out), DIGITS)


def near_vectors(q: pd.DataFrame, t: pd.DataFrame, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) with their distance that hold the ``k`` nearest rows of every query within its bound.

    Products give all distances up to rounding; pairs that are near by these, with a margin for the rounding, are measured.
    """
    a, b = np.vstack(q["x"].to_numpy()), np.vstack(t["x"].to_numpy())
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    about = na[:, None] + nb[None, :] - 2 * (a @ b.T)
    largest = max((float(n[np.isfinite(n)].max(initial=0.0)) for n in (na, nb)))
    margin = 1e-11 * a.shape[1] * largest
    with np.errstate(invalid="ignore"):
        keep = about <= ((bound + 2e-9) ** 2 + margin)[:, None]
        if keep.sum() > 4 * k * len(a) and len(b) > k:
            kth = np.partition(about, k - 1, axis=1)[:, k - 1]
            keep &= about <= ((np.sqrt(np.maximum(kth, 0.0) + margin) + 2e-9) ** 2 + margin)[:, None]
    i, j = np.nonzero(keep)
    dist = np.empty(len(i))
    for s in range(0, len(i), 65_536):  # bounded scratch memory
        dist[s : s + 65_536] = ((a[i[s : s + 65_536]] - b[j[s : s + 65_536]]) ** 2).sum(axis=1)
    dist = np.round(np.sqrt(dist), DIGITS)
    ok = (dist <= bound[i]) & np.isfinite(dist)
    return i[ok], j[ok], dist[ok]


def knn_topk(
    query: DataFrame,
    train: DataFrame,
    k: int,
    numeric: Sequence[str] = (),
    nominal: Sequence[str] = (),
    row_id: str = "id",
    label: str = "label",
    leave_self_out: bool = False,
    rows: int = BLOCK_ROWS,
    vector: str | None = None,
    cells: int | None = None,
    merged: bool = False,
) -> DataFrame:
    """Nearest distinct training rows with ties at the k-th distance kept.

    Returns ``(query, same, label, distance, w, closer)``: ``same`` identifies
    equal training rows, ``w`` how many there are with that label, and ``closer``
    how many training rows are strictly nearer.  With ``leave_self_out`` the query
    row itself is taken out of its own group.  ``cells`` sets the number of cells, which
    changes the work and not the result.  If ``merged``, training rows of one label and distance may be one row, without ``same``.
    """
    near, _ = candidates(query, train, k, numeric, nominal, row_id, label, leave_self_out, rows, vector, cells, merged)
    upto = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("query", "distance")
    out = near.withColumn("closer", F.sum("w").over(upto) - F.sum("w").over(ties))
    return out.filter(F.col("closer") < k)


def candidates(
    query: DataFrame,
    train: DataFrame,
    k: int,
    numeric: Sequence[str] = (),
    nominal: Sequence[str] = (),
    row_id: str = "id",
    label: str = "label",
    leave_self_out: bool = False,
    rows: int = BLOCK_ROWS,
    vector: str | None = None,
    cells: int | None = None,
    merged: bool = False,
) -> tuple[DataFrame, int]:
    """Rows ``(query, same, label, distance, w)`` among which the nearest are, and the number of pairs measured for them.

    If ``merged``, ``same`` is left out, and the rows of one label and distance that a query meets in a block are one row.
    """
    if vector:
        q = query.select(F.col(row_id).alias("query"), F.col(vector).alias("x"), *([F.col(label).alias("own")] if leave_self_out else []))
        t = train.select(F.col(vector).alias("x"), F.col(label).alias("label"))
        sig = F.md5(F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))))
        features = ["x"]
    else:
        stats = fit_minmax(train, numeric) if numeric else None
        features = [*numeric, *nominal]
        q = _scaled(query.select(F.col(row_id).alias("query"), *features, *([F.col(label).alias("own")] if leave_self_out else [])), stats, numeric)
        t = _scaled(train.select(*features, F.col(label).alias("label")), stats, numeric)
        sig = _signature(numeric, nominal)
    q = q.withColumn("same", sig) if leave_self_out else q
    t = t.withColumn("same", sig).groupBy("same", "label").agg(
        *[F.first(c).alias(c) for c in features], F.count(F.lit(1)).cast("double").alias("w")
    )
    if not vector:
        q, t = _named(q, nominal), _named(t, nominal)

    names = ["query", "label", "distance", "w"] if merged else ["query", "same", "label", "distance", "w"]

    def reduce_pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            step = max(16, BLOCK_PAIRS // len(b))
            for start in range(0, len(a), step):
                part = a.iloc[start : start + step]
                bound = part["_bound"].to_numpy(float)
                if vector:
                    i, j, dist = near_vectors(part, b, k + leave_self_out, bound)
                else:
                    i, j, dist = near_mixed(part, b, numeric, nominal, k + leave_self_out, bound)
                weight = b["w"].to_numpy(float)[j]
                if leave_self_out:
                    own = (part["same"].to_numpy()[i] == b["same"].to_numpy()[j]) & (part["own"].to_numpy()[i] == b["label"].to_numpy()[j])
                    weight = weight - own
                    i, j, dist, weight = (v[weight > 0] for v in (i, j, dist, weight))
                if merged:
                    i, j, dist, weight = _merged(i, j, dist, weight, pd.factorize(b["label"])[0])
                found = pd.DataFrame({"query": part["query"].to_numpy()[i], "same": b["same"].to_numpy()[j], "label": b["label"].to_numpy()[j], "distance": dist, "w": weight})
                out.append(found[names])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({n: [] for n in names})

    kind = dict(q.dtypes)["query"]
    lab = dict(t.dtypes)["label"]
    train_id = ["same", "label"]

    def build(rows_in: DataFrame, number: int) -> PivotCells | BoxCells:
        if vector:
            return PivotCells(rows_in, features, vector_distance, train_id, number)
        return BoxCells(rows_in, numeric, nominal, train_id, number, k)

    most = MAX_PIVOTS if vector else MAX_LEAVES
    return nearest(q, t, k, build, most, reduce_pair, f"query {kind}, {'' if merged else 'same string, '}label {lab}, distance double, w double", train_id, rows, cells)


def with_train_ids(near: DataFrame, train: DataFrame, numeric: Sequence[str], nominal: Sequence[str], row_id: str = "id", label: str = "label") -> DataFrame:
    """Turn groups of equal training rows back into row ids."""
    stats = fit_minmax(train, numeric) if numeric else None
    t = _scaled(train.select(F.col(row_id).alias("neighbor"), *numeric, *nominal, F.col(label).alias("label")), stats, numeric)
    ids = t.withColumn("same", _signature(numeric, nominal)).select("neighbor", "same", "label")
    return near.join(ids, ["same", "label"])


def _vote_weight(weighting: str):
    d = F.col("distance")
    return {"none": F.lit(1.0), "inverse": 1.0 / (d + 0.001), "similarity": 1.0 - d}[weighting]


def knn_vote(near: DataFrame, classes: DataFrame, n_train: DataFrame, weighting: str = "none") -> DataFrame:
    """Class shares per query; every class starts with 1 / (training rows).

    ``classes(label)`` is the domain, ``n_train(n)`` one row.  The domain meets the
    votes per query as one short array, not as a product of rows.
    """
    votes = near.groupBy("query", "label").agg(F.sum(F.col("w") * _vote_weight(weighting)).alias("v"))
    per_query = votes.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("votes"))
    domain = classes.agg(F.array_sort(F.collect_set("label")).alias("classes")).join(n_train)
    out = per_query.join(F.broadcast(domain.limit(1)))
    raw = F.transform("classes", lambda c: F.coalesce(F.try_element_at("votes", c), F.lit(0.0)) + 1.0 / F.greatest(F.col("n"), F.lit(1)))
    total = F.aggregate("raw", F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("raw", raw).withColumn("total", total).select(
        "query", "classes", F.transform("raw", lambda v: v / F.col("total")).alias("probs")
    )


def knn_regress(near: DataFrame, weighting: str = "none") -> DataFrame:
    """Numeric class: weighted mean of the neighbours' values (in ``label``)."""
    w = F.col("w") * _vote_weight(weighting)
    return near.groupBy("query").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("predicted"))


def knn_choose_k(
    train: DataFrame, kmax: int, numeric: Sequence[str] = (), nominal: Sequence[str] = (), row_id: str = "id", label: str = "label", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Hold-one-out error for k = 1..kmax from a single pairing: ``(k, n, error, best)``.

    A neighbour group takes part in every k above the number of closer rows, so
    the votes of all k come from one grouped table.
    """
    features = [*numeric, *nominal]
    single, again = _queries(train, features, row_id, label)
    near = knn_topk(single, train, kmax, numeric, nominal, "_query", label, leave_self_out=True, rows=rows, merged=True)
    errors = _wrong_per_k(near, single, kmax, "_query", label, [], "_rows")
    if not again.isEmpty():
        repeated = train.join(again, row_id, "left_semi")
        near = knn_topk(repeated, train, kmax, numeric, nominal, row_id, label, leave_self_out=True, rows=rows)
        errors = errors.unionByName(_wrong_per_k(near, repeated, kmax, row_id, label, []))
    errors = cut(errors.groupBy("k").agg(F.sum("n").alias("n"), (F.sum("wrong") / F.sum("n")).alias("error")))
    best = errors.agg(F.min(F.struct(F.round("error", 9).alias("e"), "k"))["k"].alias("_b"))
    return errors.join(F.broadcast(best.limit(1))).withColumn("best", F.col("k") == F.col("_b")).drop("_b")


def _queries(train: DataFrame, features: Sequence[str], row_id: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows ``(_query, features, label, _rows)`` of the ids that occur once, with their number, and the ids that
    occur more than once, whose rows are one query.  Rows of equal features and label have the same neighbours, each without itself."""
    kept = dict.fromkeys([*features, label])
    ids = train.filter(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("_id")).agg(F.count(F.lit(1)).alias("_often"), *[F.first(c).alias(c) for c in kept])
    marks = [F.col(c).cast("string").alias(f"_mark{i}") for i, c in enumerate(features)]  # as strings, 0.0 is not -0.0
    single = ids.filter("_often = 1").groupBy(*marks, F.col(label).alias("_label")).agg(*[F.first(c).alias(c) for c in kept], F.count(F.lit(1)).alias("_rows"))
    single = cut(single.select(F.monotonically_increasing_id().alias("_query"), *kept, "_rows"))
    again = train.groupBy(row_id).count().filter(F.col(row_id).isNotNull() & (F.col("count") > 1)).select(row_id)
    return single, cut(again)


def knn_cv_errors(folded: DataFrame, kmax: int, numeric: Sequence[str] = (), nominal: Sequence[str] = (), row_id: str = "id", label: str = "label", rows: int = BLOCK_ROWS) -> DataFrame:
    """Cross-validated error of k = 1..kmax per fold: ``(k, fold, n, error)``.

    A fold meets the rows of the other folds, and numbers are scaled with the range of those rows alone.
    """
    folds = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]
    near = [knn_topk(folded.filter(F.col("fold") == f), folded.filter(F.col("fold") != f), kmax, numeric, nominal, row_id, label, rows=rows) for f in folds]
    return _errors_per_k(cut(reduce(DataFrame.unionByName, near)), folded, kmax, row_id, label, ["fold"])


def _errors_per_k(near: DataFrame, train: DataFrame, kmax: int, row_id: str, label: str, by: Sequence[str]) -> DataFrame:
    wrong = _wrong_per_k(near, train, kmax, row_id, label, by)
    return wrong.select("k", *by, "n", (F.col("wrong") / F.col("n")).alias("error"))


def _wrong_per_k(near: DataFrame, train: DataFrame, kmax: int, row_id: str, label: str, by: Sequence[str], often: str | None = None) -> DataFrame:
    """Queries and wrong ones for each k; ``often`` says how many queries a row stands for."""
    per_k = near.select("query", "label", "w", F.explode(F.sequence((F.col("closer") + 1).cast("int"), F.lit(kmax))).alias("k"))
    votes = per_k.groupBy("query", "k", "label").agg(F.sum("w").alias("v"))
    top = votes.groupBy("query", "k").agg(F.min(F.struct((-F.col("v")).alias("s"), "label"))["label"].alias("predicted"))
    actual = train.select(F.col(row_id).alias("query"), F.col(label).alias("actual"), (F.col(often) if often else F.lit(1).cast("long")).alias("often"), *by)
    wrong = F.when(F.col("predicted") == F.col("actual"), 0).otherwise(F.col("often"))
    return top.join(actual, "query").groupBy("k", *by).agg(F.sum("often").alias("n"), F.sum(wrong).cast("double").alias("wrong"))


def last_window(train: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The latest ``n`` rows (``n`` is the window size of the learner)."""
    return train.orderBy(*[F.col(o).desc() for o in order]).limit(n)


# -- kernel scoring ------------------------------------------------------------


def kernel_score(
    query: DataFrame,
    support: DataFrame,
    gamma: float = 1.0,
    bias: float = 0.0,
    kernel: str = "rbf",
    row_id: str = "id",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``sum(alpha * K(x, support)) + b`` and its sign per query and machine; ``support(clf, x, alpha)``."""
    return kernel_scores(query, support, [gamma], bias, kernel, row_id, rows).drop("gamma")


def kernel_scores(
    query: DataFrame,
    support: DataFrame,
    gammas: Sequence[float],
    bias: float = 0.0,
    kernel: str = "rbf",
    row_id: str = "id",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``kernel_score`` for several values of ``gamma`` from one pairing, with a column ``gamma``.

    A support vector that several machines use is one row with a weight for each, so its kernel values are taken once.
    Each block pair returns one partial sum per query, machine and value; partial sums are added by a shuffle.
    """
    q = query.select(F.col(row_id).alias("row_id"), "x")
    kind, ckind = dict(q.dtypes)["row_id"], dict(support.dtypes)["clf"]
    gammas = [float(g) for g in gammas]

    def weights(b: pd.DataFrame) -> tuple[list, np.ndarray]:
        size = b["used"].map(len).to_numpy()
        entries = [e for used in b["used"] for e in used]
        codes, names = pd.factorize(np.array([e["clf"] for e in entries], dtype=object), sort=True)
        table = np.zeros((len(b), len(names)))
        known = codes >= 0
        alpha = np.array([np.nan if e["alpha"] is None else e["alpha"] for e in entries], dtype=float)
        np.add.at(table, (np.repeat(np.arange(len(b)), size)[known], codes[known]), alpha[known])
        return list(names), table

    def partial(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"row_id": [], "clf": [], "gamma": [], "part": []})
        x, y = np.vstack(a["x"].to_numpy()), np.vstack(b["x"].to_numpy())
        names, alpha = weights(b)
        norm_x, norm_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
        total = np.zeros((len(gammas), len(x), len(names)))
        for i in range(0, len(x), KERNEL_STEP):  # bounded scratch memory
            for j in range(0, len(y), KERNEL_STEP):
                u, v = slice(i, i + KERNEL_STEP), slice(j, j + KERNEL_STEP)
                inner = x[u] @ y[v].T
                if kernel == "linear":
                    total[:, u] += inner @ alpha[v]
                    continue
                inner *= -2.0
                inner += norm_x[u, None]
                inner += norm_y[None, v]
                np.maximum(inner, 0.0, out=inner)
                for g, gamma in enumerate(gammas):
                    k = inner * -gamma
                    total[g, u] += np.exp(k, out=k) @ alpha[v]
        n, m = len(x), len(names)
        out = {"row_id": np.tile(np.repeat(a["row_id"].to_numpy(), m), len(gammas)), "clf": np.tile(np.array(names, dtype=object), n * len(gammas))}
        return pd.DataFrame({**out, "gamma": np.repeat(gammas, n * m), "part": total.ravel()})

    single = support.groupBy("x", "clf").agg(F.sum("alpha").alias("alpha"))
    shared = cut(single.groupBy("x").agg(F.collect_list(F.struct("clf", "alpha")).alias("used")))
    parts = pair_blocks(q, shared, ["row_id"], ["x"], partial, f"row_id {kind}, clf {ckind}, gamma double, part double", rows, DENSE_ROWS)
    out = parts.groupBy("row_id", "clf", "gamma").agg((F.sum("part") + F.lit(bias)).alias("score"))
    return out.withColumn("sign", F.when(F.col("score") > 0, 1).otherwise(-1))


def unique_support(models: DataFrame) -> DataFrame:
    """Distinct support rows over all binary models, next to the entries used."""
    used = models.filter(F.col("alpha") != 0)
    per_row = used.groupBy("row_id").agg(F.count(F.lit(1)).alias("uses"))
    return per_row.agg(F.count(F.lit(1)).alias("distinct_rows"), F.sum("uses").alias("entries"))
