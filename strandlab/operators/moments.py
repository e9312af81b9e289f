"""Means, variances and second moments of array columns.

Per-dimension sums are plain aggregate columns (no row explosion); full second
moments are summed as one matrix per Arrow batch before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.rowblocks import codes_of
from strandlab.session import cut

VAR_FLOOR = 1e-4


def per_dim(x: str, dims: int, fn) -> Column:
    """Array of one aggregate per dimension."""
    return F.array(*[fn(F.col(x)[i]) for i in range(dims)])


def set_summary(frames: DataFrame) -> DataFrame:
    """Number of sequences, min/max/mean length, smallest and largest value."""
    seqs = frames.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("len"), F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")
    )
    return seqs.agg(
        F.count(F.lit(1)).alias("sequences"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        F.avg("len").alias("mean_len"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"),
    )


def dynamic_ranges(frames: DataFrame, dims: int, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value per dimension over all sets."""
    g = frames.groupBy(*by).agg(per_dim("x", dims, F.min).alias("lo"), per_dim("x", dims, F.max).alias("hi"))
    return g.select(*by, F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "z")).select(*by, "dim", "z.lo", "z.hi")


def global_mean_var(frames: DataFrame, dims: int) -> DataFrame:
    return class_mean_var(frames, dims, (), 0.0)


def class_mean_var(df: DataFrame, dims: int, by: Sequence[str] = ("label",), floor: float = VAR_FLOOR) -> DataFrame:
    """``(<by>, n, mean, var)`` with population variance, floored."""
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), per_dim("x", dims, F.avg).alias("mean"), per_dim("x", dims, F.var_pop).alias("var")
    )
    return g.withColumn("var", F.transform("var", lambda v: F.greatest(v, F.lit(floor))))


def by_dim(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Array columns to one row per dimension."""
    out = df.select(*keys, F.posexplode(F.arrays_zip(*cols)).alias("dim", "z"))
    return out.select(*keys, "dim", *[F.col(f"z.{c}").alias(c) for c in cols])


def second_moments(df: DataFrame, x: str, weight: str | None, by: Sequence[str] = ()) -> DataFrame:
    """``(<by>, w, gram array)``: weighted sum of outer products, row by row of the matrix.

    Every Arrow batch adds its rows with one matrix product per group and emits
    one row per group; the matrices are then summed element by element.
    """
    keys = list(by)
    src = df.select(*keys, F.col(x).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = codes_of(pa.Table.from_batches([batch]), keys)
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            m, w = flat.reshape(batch.num_rows, -1).astype(float), batch.column("w").to_numpy(zero_copy_only=False)
            heads, sums, grams = [], [], []
            order = np.argsort(code, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            for at in np.split(order, begin[1:]):
                part, weight = m[at], w[at]
                heads.append(int(at[0]))
                sums.append(float(weight.sum()))
                grams.append(((part * weight[:, None]).T @ part).ravel())
            first = [batch.column(k).take(pa.array(heads)) for k in keys]
            yield pa.RecordBatch.from_arrays([*first, pa.array(sums), pa.array(grams, pa.list_(pa.float64()))], names=[*keys, "w", "gram"])

    types = dict(src.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "w double", "gram array<double>"])
    parts = src.mapInArrow(partial, schema)
    total = parts.groupBy(*keys).agg(F.sum("w").alias("w"))
    cells = parts.select(*keys, F.posexplode("gram").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    gram = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda z: z["v"]).alias("gram"))
    return total.join(gram, keys) if keys else total.join(gram)


def weighted_covariance(df: DataFrame, dims: int, weight: str | None = None, by: Sequence[str] = (), floor: float = 0.0) -> DataFrame:
    """Full covariance per group from centred sums: ``(<by>, i, j, cov)``; the diagonal is floored."""
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.groupBy(*by).agg(F.array(*[F.sum(w * F.col("x")[i]) / F.sum(w) for i in range(dims)]).alias("_m"))
    joined = df.join(cut(means), list(by)) if by else df.join(F.broadcast(means.limit(1)))
    centred = joined.withColumn("_x", F.zip_with("x", "_m", lambda a, b: a - b))
    g = second_moments(centred, "_x", weight, by)
    out = g.select(*by, "w", F.posexplode("gram").alias("pos", "v"))
    i, j = F.expr(f"pos div {dims}").cast("int"), (F.col("pos") % dims).cast("int")
    cov = F.col("v") / F.col("w")
    return out.select(*by, i.alias("i"), j.alias("j"), F.when(i == j, F.greatest(cov, F.lit(floor))).otherwise(cov).alias("cov"))


def full_gaussian(df: DataFrame, dims: int, weight: str | None = None, by: Sequence[str] = ("label",), floor: float = VAR_FLOOR) -> DataFrame:
    """``(<by>, mean, factor)``: weighted mean and the lower Cholesky factor of the covariance, row by row.

    Variances are floored.  A covariance that is not positive definite (fewer rows than dimensions, dependent columns)
    has its eigenvalues floored as well.  Sums are distributed; only the (dims x dims) factor of a group is local.
    """
    keys = list(by)
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.groupBy(*keys).agg(F.array(*[F.sum(w * F.col("x")[i]) / F.sum(w) for i in range(dims)]).alias("mean"))
    cov = weighted_covariance(df, dims, weight, by, floor)
    whole = cov.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))), lambda z: z["cov"]).alias("cov"))
    both = means.join(whole, keys) if keys else means.join(whole)

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for flat in pdf["cov"]:
                m = np.asarray(flat, float).reshape(dims, dims)
                try:
                    low = np.linalg.cholesky(m)
                except np.linalg.LinAlgError:
                    value, vector = np.linalg.eigh((m + m.T) / 2)
                    low = np.linalg.cholesky((vector * np.maximum(value, floor or 1e-12)) @ vector.T)
                found.append([low[i, : i + 1].tolist() for i in range(dims)])
            yield pdf.drop(columns="cov").assign(factor=found)

    types = dict(both.dtypes)
    return both.mapInPandas(factor, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "mean array<double>", "factor array<array<double>>"]))


def cross_cov_regression(df: DataFrame, y: str, x: str, dims_y: int, dims_x: int, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Slope matrix ``A = Syx Sxx^-1`` per group: ``(<by>, row, col, a)``.

    The sums are distributed; only the (dims x dims) solve of a group is local.
    """
    d = dims_y + dims_x
    w = F.col(weight) if weight else F.lit(1.0)
    z = df.withColumn("_z", F.concat(F.col(y), F.col(x)))
    means = z.groupBy(*by).agg(F.array(*[F.sum(w * F.col("_z")[i]) / F.sum(w) for i in range(d)]).alias("_m"))
    joined = z.join(cut(means), list(by)) if by else z.join(F.broadcast(means.limit(1)))
    g = second_moments(joined.withColumn("_c", F.zip_with("_z", "_m", lambda a, b: a - b)), "_c", weight, by)
    keys = list(by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                s = np.asarray(rec["gram"], float).reshape(d, d)
                a = s[:dims_y, dims_y:] @ np.linalg.pinv(s[dims_y:, dims_y:])
                rows += [(*[rec[k] for k in keys], i, j, float(a[i, j])) for i in range(dims_y) for j in range(dims_x)]
            yield pd.DataFrame(rows, columns=[*keys, "row", "col", "a"])

    types = dict(g.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "row int", "col int", "a double"])
    return g.mapInPandas(solve, schema)


def param_mean_var(options: DataFrame, by: Sequence[str], param: str) -> DataFrame:
    """Mean, population variance and log2 of the mean of a tuned parameter."""
    g = options.groupBy(*by).agg(F.avg(param).alias("mean"), F.var_pop(param).alias("var"))
    return g.withColumn("log2_mean", F.when(F.col("mean") > 0, F.log2("mean")))


def linear_rls(df: DataFrame, target: str, dims: int, lam: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Regularised least squares ``(X'X + lam n I) w = X'y`` in primal form: ``(<by>, w)``.

    One distributed pass for the normal equations; the system has ``dims + 1``
    unknowns (the last one is the intercept, not regularised).
    """
    d, keys = dims + 1, list(by)
    z = df.withColumn("_z", F.concat("x", F.array(F.lit(1.0)), F.array(F.col(target).cast("double"))))
    g = second_moments(z, "_z", None, by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                s = np.asarray(rec["gram"], float).reshape(d + 1, d + 1)
                ridge = np.eye(d) * lam * rec["w"]
                ridge[-1, -1] = 0.0
                rows.append((*[rec[k] for k in keys], np.linalg.solve(s[:d, :d] + ridge, s[:d, d]).tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "w"])

    types = dict(g.dtypes)
    return g.mapInPandas(solve, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "w array<double>"]))
