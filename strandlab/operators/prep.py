"""Column selection and preprocessing fitted on a training side.

Fitted statistics are one-row DataFrames (or one row per ``by`` group), joined
back as a single row, so applying a filter is a projection on the data side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions.exprs import columns_in


def select_range(df: DataFrame, spec: str, invert: bool = False) -> DataFrame:
    return df.select(*columns_in(df.columns, spec, invert))


def drop_missing_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.dropna(subset=[label])


def drop_all_missing_columns(df: DataFrame) -> DataFrame:
    """Remove columns that are null in every row (one aggregate, one row back)."""
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first()
    if counts is None:
        return df
    return df.select(*[c for c in df.columns if counts[c] > 0])


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the most frequent non-null value per column (smallest on ties).

    Counting first keeps the state of the final aggregate to one struct per
    column, instead of one hash map over all values in a single task.
    """
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "attr", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("attr", "value").count()
    best = counts.groupBy("attr").agg(F.min(F.struct((-F.col("count")).alias("n"), "value"))["value"].alias("value"))
    return best.groupBy().pivot("attr", list(cols)).agg(F.first("value"))


def fit_impute(train: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    """One row: mean per numeric column, mode per nominal column."""
    parts = []
    if numeric:
        parts.append(train.agg(*[F.avg(c).alias(f"{c}__fill") for c in numeric]))
    if nominal:
        modes = most_frequent(train, nominal)
        parts.append(modes.select(*[F.col(c).alias(f"{c}__fill") for c in nominal]))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


def apply_impute(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace nulls by the fitted fill values (``stats`` has exactly one row)."""
    joined = df.join(F.broadcast(stats.limit(1)))
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__fill")) for c in cols}).select(*df.columns)


def impute_mean_mode(df: DataFrame, train: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> DataFrame:
    return apply_impute(df, fit_impute(train, numeric, nominal), [*numeric, *nominal])


def fit_minmax(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    return train.agg(
        *[F.min(c).alias(f"{c}__lo") for c in cols],
        *[F.max(c).alias(f"{c}__hi") for c in cols],
    )


def minmax_expr(x: Column, lo: Column, hi: Column) -> Column:
    """Scaled value; 0 when the range is empty or unseen, null stays null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(
        lo.isNull() | (lo == hi), F.lit(0.0)
    ).otherwise((x - lo) / (hi - lo))


def apply_minmax(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    joined = df.join(F.broadcast(stats.limit(1)))
    return joined.withColumns(
        {c: minmax_expr(F.col(c), F.col(f"{c}__lo"), F.col(f"{c}__hi")) for c in cols}
    ).select(*df.columns)


def minmax_scale(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_minmax(df, fit_minmax(train, cols), cols)


def fit_standardize(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and sample deviation; a variance that is null or not positive counts as 1."""
    sd = {c: F.when(F.var_samp(c) > 0, F.stddev_samp(c)).otherwise(F.lit(1.0)) for c in cols}
    return train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in cols],
        *[sd[c].alias(f"{c}__sd") for c in cols],
    )


def apply_standardize(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    joined = df.join(F.broadcast(stats.limit(1)))
    return joined.withColumns(
        {c: (F.col(c) - F.col(f"{c}__mean")) * (1.0 / F.col(f"{c}__sd")) for c in cols}
    ).select(*df.columns)


def standardize(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_standardize(df, fit_standardize(train, cols), cols)


MAX_DOMAIN = 10_000  # one indicator column per value has to stay a schema, not data


def nominal_domain(train: DataFrame, col: str) -> list[str]:
    """Sorted values of a nominal column; refuses columns that are not nominal."""
    rows = train.select(F.col(col).cast("string").alias("v")).dropna().distinct().limit(MAX_DOMAIN + 1).collect()
    if len(rows) > MAX_DOMAIN:
        raise ValueError(f"{col} has more than {MAX_DOMAIN} values; it is not nominal")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Replace nominal columns by 0/1 columns ``col=value`` over the fitted domain.

    Two-valued attributes become a single column (the second value is 1).  A null
    stays null in all of its columns.
    """
    out, drop = {}, []
    for col, values in domains.items():
        drop.append(col)
        for v in values[1:] if len(values) == 2 else values:
            hit = F.when(F.col(col) == v, F.lit(1.0)).otherwise(F.lit(0.0))
            out[f"{col}={v}"] = F.when(F.col(col).isNotNull(), hit)
    return df.withColumns(out).drop(*drop)


def prep_pipeline(
    train: DataFrame,
    df: DataFrame,
    numeric: Sequence[str],
    nominal: Sequence[str],
    scaling: str = "minmax",
) -> DataFrame:
    """Impute, one-hot, scale: each step only if the training side needs it.

    Everything is fitted on ``train`` and applied to ``df``.
    """
    cols = [*numeric, *nominal]
    nulls = train.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in cols]).first()
    test_nulls = df.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in cols]).first()
    out, fitted = df, train
    if any(nulls[c] or test_nulls[c] for c in cols):
        fill = fit_impute(train, numeric, nominal)
        out, fitted = apply_impute(out, fill, cols), apply_impute(fitted, fill, cols)
    if numeric and scaling == "minmax":
        out = apply_minmax(out, fit_minmax(fitted, numeric), numeric)
    elif numeric and scaling == "standard":
        out = apply_standardize(out, fit_standardize(fitted, numeric), numeric)
    if nominal:
        out = one_hot(out, {c: nominal_domain(fitted, c) for c in nominal})
    return out


def quantize(df: DataFrame, cols: Sequence[str], ranges: dict[str, tuple[float, float]], levels: int) -> DataFrame:
    """``round((x - min) / step)`` with ``levels`` steps, clamped at both ends."""
    out = {}
    for c in cols:
        lo, hi = ranges[c]
        step = (hi - lo) / (levels - 1)
        q = F.floor((F.col(c) - lo) / step + 0.5)
        out[f"{c}_q"] = F.greatest(F.lit(0).cast("long"), F.least(F.lit(levels - 1).cast("long"), q)).cast("int")
        out[f"{c}_q"] = F.when(F.col(c).isNotNull(), out[f"{c}_q"])
    return df.withColumns(out)
