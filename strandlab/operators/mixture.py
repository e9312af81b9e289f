"""Gaussian mixtures trained by distributed sums.

A model is a table ``(<by>, comp, weight, mean, var)``.  The rows of a training are
packed into blocks of one group once; a round joins the blocks with the models on
``by`` and adds up a block with numpy, and the M-step is one partial aggregate over
the blocks' sums.  Models of all groups are trained in the same jobs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import LOG_ZERO, gaussian_logpdf, log_sum_exp, softmax
from strandlab.operators.moments import VAR_FLOOR, class_mean_var
from strandlab.operators.rowblocks import block_values, row_blocks
from strandlab.session import cut

SPLIT_STEP = 0.2  # in standard deviations
LOG_WEIGHT_FLOOR = 1e-30


def one_gaussian(df: DataFrame, dims: int, by: Sequence[str] = ("label",), floor: float = VAR_FLOOR) -> DataFrame:
    m = class_mean_var(df, dims, by, floor)
    return m.select(*by, F.lit(0).alias("comp"), F.lit(1.0).alias("weight"), "mean", "var")


def packed(model: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group with the components as an array."""
    return model.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("comp", F.log(F.greatest("weight", F.lit(LOG_WEIGHT_FLOOR))).alias("logw"), "mean", "var"))).alias("_g")
    )


def component_logs(x: Column, comps: Column) -> Column:
    return F.transform(comps, lambda g: g["logw"] + gaussian_logpdf(x, g["mean"], g["var"]))


UNROLLED_TERMS = 64  # components x dimensions written out as plain expressions


def unrolled_logs(x: Column, comps: Column, k: int, dims: int) -> Column:
    """``component_logs`` for a small model, as generated code instead of lambdas."""
    out = []
    for j in range(k):
        g = comps[j]
        total = g["logw"] - 0.5 * dims * math.log(2 * math.pi)
        for i in range(dims):
            gap = x[i] - g["mean"][i]
            total = total - 0.5 * (gap * gap / g["var"][i] + F.log(g["var"][i]))
        out.append(F.when(F.size(comps) > j, F.coalesce(total, F.lit(LOG_ZERO))))
    return F.array_compact(F.array(*out))


def with_logs(df: DataFrame, model: DataFrame, by: Sequence[str], dims: int | None = None) -> DataFrame:
    """Add ``_logs`` (log weight + log density per component) and ``loglik``.

    With ``dims`` a small model is written out; this asks for its largest number
    of components first (one number from a small table).
    """
    p = packed(model, by)
    joined = df.join(p, list(by)) if by else df.join(p)
    k = 0 if dims is None else (model.groupBy(*by).count().agg(F.max("count")).first()[0] or 0)
    if k and k * dims <= UNROLLED_TERMS:
        out = joined.withColumn("_logs", unrolled_logs(F.col("x"), F.col("_g"), k, dims))
    else:
        out = joined.withColumn("_logs", component_logs(F.col("x"), F.col("_g")))
    return out.withColumn("loglik", log_sum_exp(F.col("_logs")))


def as_blocks(df: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    return df if "gaps" in df.columns else row_blocks(df, by, dims)


BLOCK_CELLS = 131_072  # rows x components that are computed at once


def log_densities(x: np.ndarray, logw: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(components, rows) of log weight + log density of ``x`` (dims, rows); null or NaN gives log zero."""
    out = (logw - 0.5 * (np.log(var).sum(1) + len(x) * math.log(2 * math.pi)))[:, None]
    for i in range(len(x)):
        gap = x[i] - mean[:, i, None]
        out = out - gap * gap * (0.5 / var[:, i, None])
    return np.where(np.isnan(out), LOG_ZERO, out)


def shares_of(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components, and the log of their sum, of every row."""
    top = logs.max(axis=0)
    e = np.exp(logs - top)
    z = e.sum(axis=0)
    shares, total = e / z, top + np.log(z)
    lost = total <= LOG_ZERO / 2  # no density at all: every such component counts whole
    if lost.any():
        shares[:, lost] = np.exp(logs[:, lost] - total[lost])
    return shares, total


def _components(column: pa.ListArray, dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(comp, logw, mean, var)`` of every row of a packed model; blocks of one group share them."""
    ends = column.offsets.to_numpy()
    flat = column.values
    comp, logw = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("comp", "logw"))
    mean, var = (flat.field(c).values.to_numpy(zero_copy_only=False).reshape(-1, dims) for c in ("mean", "var"))
    for a, z in zip(ends[:-1], ends[1:]):
        yield comp[a:z], logw[a:z], mean[a:z], var[a:z]


def _or_null(sums: np.ndarray, whole: np.ndarray) -> list:
    """Rows of sums as lists; a dimension without a value has no sum."""
    return [[v if ok else None for v, ok in zip(row, whole)] for row in sums.tolist()]


def block_sums(blocks: DataFrame, model: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    """E-step of every block: ``(<by>, comp, occ, loglik, n, s1, s2)``.

    ``loglik`` and ``n`` are the block's and stand on each of its components.  A row with a null value has log density
    zero for all components; its other values count.
    """
    keys, kind = list(by), dict(blocks.dtypes)
    p = packed(model, by)
    joined = (blocks.join(p, keys) if keys else blocks.join(p)).select(*keys, "n", "x", "gaps", "_g")
    fields = ["comp", "occ", "loglik", "n", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for number, ((x, null), (comp, logw, mean, var)) in enumerate(zip(block_values(batch, dims), _components(batch.column("_g"), dims))):
                k = len(comp)
                occ, s1, s2, total = np.zeros(k), np.zeros((k, dims)), np.zeros((k, dims)), 0.0
                step = max(1_024, BLOCK_CELLS // k)
                for a in range(0, x.shape[1], step):
                    part = x[:, a : a + step]
                    r, ll = shares_of(log_densities(part, logw, mean, var))
                    part = part if null is None else np.where(null[:, a : a + step], 0.0, part)
                    occ += r.sum(axis=1)
                    total += float(ll.sum())
                    s1 += r @ part.T
                    s2 += r @ (part * part).T
                there = np.ones(dims, bool) if null is None else ~null.all(axis=1)
                rows += zip(comp.tolist(), occ.tolist(), [total] * k, [x.shape[1]] * k, _or_null(s1, there), _or_null(s2, there))
                at += [number] * k
            cols = list(zip(*rows)) if rows else [[]] * len(fields)
            heads = [batch.column(c).take(pa.array(at, pa.int64())) for c in keys]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*keys, *fields])

    schema = ", ".join([*[f"`{k}` {kind[k]}" for k in keys], "comp int, occ double, loglik double, n long, s1 array<double>, s2 array<double>"])
    return joined.mapInArrow(run, schema)


def gmm_em_step(df: DataFrame, model: DataFrame, dims: int, by: Sequence[str] = ("label",), floor: float = VAR_FLOOR, weight_floor: float = 0.0, written: bool = False) -> DataFrame:
    """One EM step over rows or their blocks; ``loglik`` and ``n`` describe the model that came in.

    The model is written out first unless the caller did (``written``): with a known
    size it is broadcast and the rows stay where they are.
    """
    model = model if written else cut(model)
    sums = block_sums(as_blocks(df, by, dims), model, by, dims).groupBy(*by, "comp").agg(
        F.sum("occ").alias("occ"), F.sum("loglik").alias("loglik"), F.sum("n").alias("n"), *[F.array(*[F.sum(F.col(s)[i]) for i in range(dims)]).alias(s) for s in ("s1", "s2")]
    )
    return m_step(sums, model, by, floor, weight_floor)


def m_step(sums: DataFrame, model: DataFrame, by: Sequence[str], floor: float, weight_floor: float = 0.0) -> DataFrame:
    """Sums ``(occ, s1, s2)`` to weights, means and floored variances.

    A component that received nothing keeps its old mean and variance.
    """
    old = model.select(*by, "comp", F.col("mean").alias("_m"), F.col("var").alias("_v"))
    j = sums.join(old, [*by, "comp"])
    total = F.sum("occ").over(Window.partitionBy(*(by or [F.lit(0)])))
    occ = F.col("occ")
    live = occ > 1e-10
    mean = F.when(live, F.transform("s1", lambda a: a / occ)).otherwise(F.col("_m"))
    j = j.withColumn("weight", F.greatest(occ / total, F.lit(weight_floor))).withColumn("mean", mean)
    var = F.zip_with("s2", "mean", lambda q, m: F.greatest(q / occ - m * m, F.lit(floor)))
    j = j.withColumn("var", F.when(live, var).otherwise(F.col("_v")))
    if weight_floor:
        j = j.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*(by or [F.lit(0)]))))
    return j.select(*by, "comp", "weight", "mean", "var", "loglik", "n")


def split_heaviest(model: DataFrame, by: Sequence[str] = ("label",), merit: str = "weight") -> DataFrame:
    """Split the component with the largest ``merit``; means move by a share of the deviation."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    first = w.orderBy(F.round(merit, 12).desc(), "comp")
    m = model.withColumns({"_r": F.row_number().over(first), "_next": F.max("comp").over(w) + 1})

    def moved(sign: float) -> Column:
        return F.zip_with("mean", "var", lambda a, v: a + F.lit(sign * SPLIT_STEP) * F.sqrt(v))

    heavy = F.col("_r") == 1
    parts = F.when(
        heavy,
        F.array(
            F.struct(F.col("comp").alias("comp"), (F.col("weight") / 2).alias("weight"), moved(-1.0).alias("mean")),
            F.struct(F.col("_next").alias("comp"), (F.col("weight") / 2).alias("weight"), moved(1.0).alias("mean")),
        ),
    ).otherwise(F.array(F.struct("comp", "weight", "mean")))
    return m.select(*by, F.explode(parts).alias("p"), "var").select(*by, "p.comp", "p.weight", "p.mean", "var")


def gmm_iterate(df: DataFrame, model: DataFrame, dims: int, by: Sequence[str] = ("label",), max_iter: int = 100, tol: float = 1e-4, floor: float = VAR_FLOOR, weight_floor: float = 0.0) -> DataFrame:
    """EM until the log-likelihood per row of every group moves less than ``tol``.

    The model is written each round; one row tells whether to go on.
    """
    previous = None
    df = as_blocks(df, by, dims)
    for _ in range(max_iter):
        step = cut(gmm_em_step(df, model, dims, by, floor, weight_floor, written=previous is not None))
        model = step.drop("loglik", "n")
        now = step.groupBy(*by).agg(F.max(F.col("loglik") / F.col("n")).alias("ll"))
        if previous is not None:
            diff = now.join(previous.withColumnRenamed("ll", "old"), list(by)) if by else now.join(previous.withColumnRenamed("ll", "old"))
            moved = diff.agg(F.max(F.abs(F.col("ll") - F.col("old")))).first()[0]
            if moved is None or moved < tol:
                break
        previous = now
    return step


def gmm_fit(df: DataFrame, dims: int, k: int, by: Sequence[str] = ("label",), max_iter: int = 100, tol: float = 1e-4, floor: float = VAR_FLOOR, blocks: DataFrame | None = None) -> DataFrame:
    """Grow every group's mixture to ``k`` components: split the heaviest, then EM.  ``blocks`` are the rows' blocks if the caller has them."""
    model = cut(one_gaussian(df, dims, by, floor))
    blocks = as_blocks(df, by, dims) if blocks is None and k > 1 else blocks
    for _ in range(k - 1):
        model = gmm_iterate(blocks, split_heaviest(model, by), dims, by, max_iter, tol, floor).drop("loglik", "n")
    return model


def gmm_loglik(df: DataFrame, model: DataFrame, by: Sequence[str] = ("label",), dims: int | None = None) -> DataFrame:
    """Log-likelihood and number of rows of every group; blocks of rows need ``dims``."""
    if dims is None:
        return with_logs(df, model, by).groupBy(*by).agg(F.sum("loglik").alias("loglik"), F.count(F.lit(1)).alias("n"))
    sums = block_sums(as_blocks(df, by, dims), model, by, dims)
    first = sums.groupBy(*by, "comp").agg(F.sum("loglik").alias("loglik"), F.sum("n").alias("n"))  # equal for all components of a group
    return first.groupBy(*by).agg(F.max("loglik").alias("loglik"), F.max("n").alias("n"))


def gmm_select_bic(df: DataFrame, dims: int, by: Sequence[str] = ("label",), lam: float = 1.0, max_k: int | None = None, max_iter: int = 100, tol: float = 1e-4, floor: float = VAR_FLOOR) -> DataFrame:
    """Add components while ``L - lam/2 * k (2d + 1) * ln n`` grows, group by group.

    All groups that still grow are trained together; a finished group leaves the
    data of the next round.
    """

    def bic(model: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        ll = gmm_loglik(rows, model, by, dims)
        return cut(ll.select(*by, (F.col("loglik") - 0.5 * lam * k * (2 * dims + 1) * F.log(F.col("n"))).alias("bic")))

    model = cut(one_gaussian(df, dims, by, floor))
    blocks = as_blocks(df, by, dims)
    best = bic(model, blocks, 1)
    done: DataFrame | None = None
    rows, k = blocks, 1
    while max_k is None or k < max_k:
        k += 1
        grown = gmm_iterate(rows, split_heaviest(model, by), dims, by, max_iter, tol, floor).drop("loglik", "n")
        score = bic(grown, rows, k)
        gain = score.join(best.withColumnRenamed("bic", "old"), list(by))
        better = cut(gain.filter(F.col("bic") > F.col("old")).select(*by))
        stopped = model.join(better, list(by), "left_anti")
        done = stopped if done is None else done.unionByName(stopped)
        if not better.take(1):
            return done
        model = cut(grown.join(better, list(by), "left_semi"))
        best = cut(score.join(better, list(by), "left_semi"))
        rows = blocks.join(better, list(by), "left_semi")
    return model if done is None else done.unionByName(model)


MODEL_PART = 2_000  # components carried by one model row


def gmm_classify(df: DataFrame, model: DataFrame, priors: DataFrame | None = None, row_id: str = "id", label: str = "label") -> DataFrame:
    """``(row_id, label, loglik, prob)``: densities shifted by their maximum, times priors.

    Models travel as rows of at most about ``MODEL_PART`` components.  With one
    such row a data row is scored where it lies; more rows are combined per data row.
    """
    model = cut(model)
    parts = max(1, -(-model.count() // MODEL_PART))
    per_class = packed(model, [label]).withColumn("_part", F.pmod(F.xxhash64(label), F.lit(parts)))
    if priors is not None:
        per_class = per_class.join(priors.select(label, F.log("prior").alias("_lp")), label)
    else:
        per_class = per_class.withColumn("_lp", F.lit(0.0))
    rows = per_class.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "_lp", "_g"))).alias("_models"))
    keyed = df.select(F.col(row_id).alias("row_id"), "x")
    if parts > 1:
        keyed = keyed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        joined = keyed.join(rows, "_part")
    else:
        joined = keyed.join(rows.drop("_part"))
    scored = joined.select(
        "row_id",
        F.transform("_models", lambda m: F.struct(m["label"].alias("label"), m["_lp"].alias("lp"), log_sum_exp(component_logs(F.col("x"), m["_g"])).alias("ll"))).alias("_s"),
    )
    if parts > 1:
        scored = scored.groupBy("row_id").agg(F.array_sort(F.flatten(F.collect_list("_s"))).alias("_s"))
    probs = softmax(F.transform("_s", lambda s: s["ll"] + s["lp"]))
    flat = scored.select("row_id", F.explode(F.arrays_zip("_s", probs.alias("prob"))).alias("z"))
    return flat.select("row_id", F.col("z._s.label").alias("label"), F.col("z._s.ll").alias("loglik"), F.col("z.prob").alias("prob"))


def drop_light_components(model: DataFrame, floor: float, by: Sequence[str] = ("label",)) -> DataFrame:
    """Remove components below the weight floor and renormalise the rest."""
    kept = model.filter(F.col("weight") >= floor)
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(*(by or [F.lit(0)]))))


def full_classify(df: DataFrame, model: DataFrame, priors: DataFrame | None = None, row_id: str = "id", label: str = "label") -> DataFrame:
    """``(row_id, label, loglik, prob)`` of full-covariance class densities ``(label, mean, factor)``, times priors."""
    per_class = model.withColumn("_lp", F.lit(0.0)) if priors is None else model.join(priors.select(label, F.log("prior").alias("_lp")), label)
    one = cut(per_class.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "_lp", "mean", "factor"))).alias("_models")))
    found = one.select("_models._lp", "_models.mean", "_models.factor").first()  # classes x dims x dims numbers
    lp = np.array(found["_lp"], float)
    dims = max((len(f) for f in found["factor"]), default=0)
    mean = np.array(found["mean"], float).reshape(len(lp), dims)
    factor = np.zeros((len(lp), dims, dims))
    for c, rows in enumerate(found["factor"]):
        for i, row in enumerate(rows):
            factor[c, i, : i + 1] = row
    cols = [f"_x{i}" for i in range(dims)]
    keyed = df.select(F.col(row_id).alias("row_id"), *[F.when(F.size("x") == dims, F.get("x", F.lit(i))).cast("double").alias(c) for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in cols]
            ll = np.stack([full_log_density(x, m, f, batch.num_rows) for m, f in zip(mean, factor)], axis=1) if len(lp) else np.zeros((batch.num_rows, 0))
            prob = shares_of((ll + lp).T)[0].T if len(lp) else ll
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(lp))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel())) for v in (ll, prob)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *lists], names=["row_id", "ll", "prob"])

    scored = keyed.mapInArrow(run, f"row_id {dict(keyed.dtypes)['row_id']}, ll array<double>, prob array<double>")
    scored = scored.join(F.broadcast(one.select(F.col("_models.label").alias("names")).limit(1)))
    flat = scored.select("row_id", F.explode(F.arrays_zip("names", "ll", "prob")).alias("z"))
    return flat.select("row_id", F.col("z.names").alias("label"), F.col("z.ll").alias("loglik"), F.col("z.prob").alias("prob"))


def full_log_density(x: Sequence[np.ndarray], mean: np.ndarray, factor: np.ndarray, rows: int) -> np.ndarray:
    """``gaussian_logpdf_full`` of many rows, given dimension by dimension; null or NaN gives log zero."""
    solved: list[np.ndarray] = []
    total = np.full(rows, len(x) * math.log(2 * math.pi))
    for i, v in enumerate(x):
        known = sum((y * factor[i, j] for j, y in enumerate(solved)), np.zeros(rows))
        solved.append((v - mean[i] - known) / factor[i, i])
        total += solved[-1] * solved[-1] + 2.0 * np.log(factor[i, i])
    return np.where(np.isnan(total), LOG_ZERO, -0.5 * total)


def discriminative_sums(df: DataFrame, model: DataFrame, dims: int, label: str = "label", shares: DataFrame | None = None) -> DataFrame:
    """The model, over rows or blocks of one class, with its occupancies under the own class (``occ``) and under all classes (``occ_g``), the differences of
    the first and second sums, and ``posterior``: the rows' total log probability of their class.

    The pooled model holds the components of all classes, weighted by the class shares.  Every block meets it once and a task
    adds up its blocks; the own class's posteriors are the same logs restricted to its components.
    """
    clean = df.filter(F.col(label).isNotNull())
    if shares is None:
        shares = class_shares(clean, label)
    pooled = cut(
        model.join(shares, label).agg(
            F.array_sort(F.collect_list(F.struct(F.col(label).alias("cls"), "comp", F.log(F.greatest(F.col("weight") * F.col("share"), F.lit(LOG_WEIGHT_FLOOR))).alias("logw"), "mean", "var"))).alias("_g")
        )
    )
    mine = F.transform("_g", lambda g: g["cls"] == F.col(label)).alias("_mine")
    rows = as_blocks(clean, [label], dims).join(F.broadcast(pooled.limit(1))).select("n", "x", "gaps", "_g", mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, posterior, n = None, 0.0, 0
        for batch in batches:
            for number, ((x, null), (comp, logw, mean, var)) in enumerate(zip(block_values(batch, dims), _components(batch.column("_g"), dims))):
                own = np.array(batch.column("_mine")[number].as_py(), bool)[:, None]
                if total is None:  # own, all, differences of first and second sums; rows with a value
                    total = [np.zeros(len(comp)), np.zeros(len(comp)), np.zeros((len(comp), dims)), np.zeros((len(comp), dims)), np.zeros(dims, bool)]
                step = max(1_024, BLOCK_CELLS // len(comp))
                for a in range(0, x.shape[1], step):
                    part = x[:, a : a + step]
                    logs = log_densities(part, logw, mean, var)
                    every, ll_every = shares_of(logs)
                    inside, ll_inside = shares_of(np.where(own, logs, LOG_ZERO))
                    part = part if null is None else np.where(null[:, a : a + step], 0.0, part)
                    gap = inside - every
                    for held, more in zip(total, (inside.sum(axis=1), every.sum(axis=1), gap @ part.T, gap @ (part * part).T)):
                        held += more
                    posterior += float((ll_inside - ll_every).sum())
                total[4] |= True if null is None else ~null.all(axis=1)
                n += x.shape[1]
        if total is not None:
            k = len(total[0])
            cols = [range(k), total[0], total[1], _or_null(total[2], total[4]), _or_null(total[3], total[4]), [posterior] * k, [n] * k]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["pos", "occ", "occ_g", "d1", "d2", "posterior", "n"])

    parts = rows.mapInArrow(run, "pos int, occ double, occ_g double, d1 array<double>, d2 array<double>, posterior double, n long")
    sums = parts.groupBy("pos").agg(
        F.sum("occ").alias("occ"), F.sum("occ_g").alias("occ_g"), *[F.array(*[F.sum(F.col(c)[i]) for i in range(dims)]).alias(c) for c in ("d1", "d2")],
        F.sum("posterior").alias("posterior"), F.sum("n").alias("n"),
    )
    names = pooled.select(F.posexplode("_g").alias("pos", "g")).select("pos", F.col("g.cls").alias(label), "g.comp")
    sums = sums.join(names, "pos").drop("pos")
    return model.select(label, "comp", "weight", "mean", "var").join(sums, [label, "comp"]).withColumn("surplus", F.col("occ") - F.col("occ_g"))


def class_shares(df: DataFrame, label: str = "label") -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return cut(n.select(label, (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share")))  # one row a class


def discriminative_update(sums: DataFrame, label: str = "label", smooth: float = 2.0, floor: float = VAR_FLOOR) -> DataFrame:
    """New weights, means and variances: own-class sums minus the sums under all classes.

    ``D = smooth * occupancy of the pooled sums`` (at least one) keeps the variances positive.
    """
    j = sums.withColumn("_d", F.greatest(F.lit(smooth) * F.col("occ_g"), F.lit(1.0))).withColumn("_den", F.col("surplus") + F.col("_d"))
    j = j.withColumn("_m", F.zip_with("d1", "mean", lambda s, m: (s + F.col("_d") * m) / F.col("_den")))
    j = j.withColumn("_q", F.zip_with("d2", F.zip_with("mean", "var", lambda m, v: v + m * m), lambda s, q: (s + F.col("_d") * q) / F.col("_den")))
    j = j.withColumn("_v", F.zip_with("_q", "_m", lambda q, m: F.greatest(q - m * m, F.lit(floor))))
    j = j.withColumn("_w", F.greatest(F.col("surplus") + F.col("_d") * F.col("weight"), F.lit(1e-10)))
    return j.select(label, "comp", (F.col("_w") / F.sum("_w").over(Window.partitionBy(label))).alias("weight"), F.col("_m").alias("mean"), F.col("_v").alias("var"), "surplus")


def gmm_discriminative_step(df: DataFrame, model: DataFrame, dims: int, label: str = "label", smooth: float = 2.0, floor: float = VAR_FLOOR) -> DataFrame:
    """One mutual-information update; ``surplus`` is the occupancy difference that chooses the components to split."""
    return discriminative_update(discriminative_sums(df, cut(model), dims, label), label, smooth, floor)


def gmm_discriminative_fit(
    df: DataFrame, model: DataFrame, dims: int, label: str = "label", tol: float = 1e-4, max_iter: int = 100, smooth: float = 1.2, small: int = 3, stall: int = 10, floor: float = VAR_FLOOR, shares: DataFrame | None = None,
) -> tuple[DataFrame, float]:
    """Mutual-information updates from ``model``: the best model met, with its sums, and its mean log posterior.

    The updates end after ``small`` changes below ``tol`` in a row, ``stall`` rounds without a better model, or
    ``max_iter`` models.  ``smooth`` grows by a fifth where a small change is for the worse.
    """
    best, top, at = None, None, 0
    old, calm = None, 0
    model = cut(model)
    if shares is None:
        shares = class_shares(df.filter(F.col(label).isNotNull()), label)
    df = as_blocks(df, [label], dims)
    for number in range(max_iter):
        sums = cut(discriminative_sums(df, model, dims, label, shares))
        total = sums.agg(F.max("posterior").alias("p"), F.max("n").alias("n")).first()
        now = total["p"] / total["n"]
        if top is None or now > top:
            best, top, at = sums, now, number
        change = float("inf") if old is None else now - old
        calm = calm + 1 if abs(change) < tol else 0
        if calm and change < 0:
            smooth *= 1.2
        if calm >= small or number - at >= stall or number + 1 == max_iter:
            break
        old = now
        model = cut(discriminative_update(sums, label, smooth, floor).drop("surplus"))
    return best, top


def split_surplus(sums: DataFrame, share: float, label: str = "label") -> DataFrame:
    """Split every component whose surplus is above ``share`` of the largest one; the means move by a share of the deviation."""
    top = sums.agg(F.max("surplus").alias("_top"))
    last = Window.partitionBy(label)
    m = sums.join(F.broadcast(top.limit(1))).withColumn("_cut", F.col("surplus") > share * F.col("_top"))
    nth = F.sum(F.col("_cut").cast("int")).over(last.orderBy("comp").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = m.withColumn("_next", F.max("comp").over(last) + nth)

    def moved(sign: float) -> Column:
        return F.zip_with("mean", "var", lambda a, v: a + F.lit(sign * SPLIT_STEP) * F.sqrt(v))

    half = F.col("weight") / 2
    two = F.array(F.struct(F.col("comp").alias("comp"), half.alias("weight"), moved(-1.0).alias("mean")), F.struct(F.col("_next").cast("int").alias("comp"), half.alias("weight"), moved(1.0).alias("mean")))
    return m.select(label, F.explode(F.when(F.col("_cut"), two).otherwise(F.array(F.struct("comp", "weight", "mean")))).alias("p"), "var").select(label, "p.comp", "p.weight", "p.mean", "var")


def gmm_grow_discriminative(
    df: DataFrame, dims: int, label: str = "label", lam: float = 1.0, share: float = 0.2, tol: float = 1e-4, max_iter: int = 4, mean_k: float | None = None, floor: float = VAR_FLOOR
) -> DataFrame:
    """Grow the class mixtures where the classes are confused: ``(label, comp, weight, mean, var, surplus)``.

    From one Gaussian a class, each round splits all components with a surplus above ``share`` of the largest (more rows of
    their class than the pooled model gives them), updates at most ``max_iter`` models discriminatively, and goes on while
    the total log posterior less ``lam / 2 * components * (2 dims + 1) * ln n`` gains at least ``tol``.  ``mean_k`` bounds the mean number of
    components of a class.
    """
    clean = df.filter(F.col(label).isNotNull())
    shares = class_shares(clean, label)
    blocks = as_blocks(clean, [label], dims)
    best, mean = gmm_discriminative_fit(blocks, one_gaussian(clean, dims, [label], floor), dims, label, tol, floor=floor, shares=shares)
    n = best.agg(F.max("n")).first()[0]

    def penalised(sums: DataFrame, mean: float) -> tuple[float, int]:
        k = sums.count()  # components of all classes
        return mean * n - 0.5 * lam * k * (2 * dims + 1) * math.log(n), k

    top, k = penalised(best, mean)
    classes = k
    while True:
        grown = cut(split_surplus(best, share, label))
        if mean_k is not None and grown.count() > mean_k * classes:
            break
        now, mean = gmm_discriminative_fit(blocks, grown, dims, label, tol, max_iter, floor=floor, shares=shares)
        value, _ = penalised(now, mean)
        if value - top < tol:
            break
        best, top = now, value
    return best.select(label, "comp", "weight", "mean", "var", "surplus")
