"""Naive Bayes over contingency counts and moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import normal_interval, softmax
from strandlab.operators.blocks import pair_blocks
from strandlab.operators.counts import contingency
from strandlab.session import cut

LIKELIHOOD_FLOOR = 1e-75
DEFAULT_PRECISION = 0.01
CLASS_ATTR = "\u0000class"  # constant attribute that counts the classes


def nominal_model(counts: DataFrame, domains: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(<by>, attr, value, label, p)`` with one extra count per domain value.

    ``domains(attr, value)`` is the closed value list, ``counts`` the training
    side; values never seen with a class keep the extra count only.
    """
    groups = counts.select(*by, "label").distinct()
    grid = groups.join(domains.select("attr", "value"))
    full = grid.join(counts, [*by, "attr", "value", "label"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + 1.0)
    total = F.sum("w").over(Window.partitionBy(*by, "attr", "label"))
    return full.select(*by, "attr", "value", "label", (F.col("w") / total).alias("p"))


def numeric_model(df: DataFrame, attrs: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``(<by>, attr, label, mean, sd, width)`` of a normal per class.

    ``width`` is the mean gap of distinct values over all classes; the gaps
    telescope, so it needs only the range and the distinct count.  The deviation
    is at least a sixth of it, and values are rounded to its grid.
    """
    clean = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    long = clean.unpivot(
        [*[F.col(b) for b in by], F.col("label")], [F.col(a).cast("double").alias(a) for a in attrs], "attr", "value"
    ).filter(F.col("value").isNotNull())
    keys = [*by, "attr"]
    spread = (
        long.groupBy(*keys, "value").agg(F.lit(1).alias("one")).groupBy(*keys)
        .agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count(F.lit(1)).alias("d"))
    )
    width = spread.select(
        *keys, F.when(F.col("d") > 1, (F.col("hi") - F.col("lo")) / (F.col("d") - 1)).otherwise(DEFAULT_PRECISION).alias("width")
    )
    width = cut(width)  # a sized table: the rows are not shuffled by attribute
    gridded = long.join(width, keys).withColumn("g", F.floor(F.col("value") / F.col("width") + 0.5) * F.col("width"))
    stats = gridded.groupBy(*keys, "label").agg(
        F.avg("g").alias("mean"), F.stddev_pop("g").alias("sd"), F.max("width").alias("width")
    )
    return stats.withColumn("sd", F.greatest(F.col("sd"), F.col("width") / 6))


MAX_UNROLLED = 64  # classes that get an expression of their own


def _numeric_logs(rows: DataFrame, model: DataFrame, attr: str, classes: list, on: Sequence[str]) -> DataFrame:
    """Add ``_lk``, the log likelihoods of a numeric attribute in class order.

    The model of the attribute is one row (per ``by`` group) with a column per class
    and parameter, so the densities are plain generated code.
    """
    part = model.filter(F.col("attr") == attr)
    cols = [
        F.max(F.when(F.col("label") == c, F.col(p))).alias(f"_{p}{i}") for i, c in enumerate(classes) for p in ("mean", "sd")
    ]
    side = part.groupBy(*on).agg(F.max("width").alias("_width"), *cols)
    out = rows.join(side, list(on), "left") if on else rows.join(side)
    x = F.floor(F.col(attr).cast("double") / F.col("_width") + 0.5) * F.col("_width")
    logs = [
        F.log(F.greatest(normal_interval(x, F.col(f"_mean{i}"), F.col(f"_sd{i}"), F.col("_width")), F.lit(LIKELIHOOD_FLOOR)))
        for i in range(len(classes))
    ]
    out = out.withColumn("_lk", F.when(F.col(attr).isNotNull() & F.col("_width").isNotNull(), F.array(*logs)))
    return out.drop("_width", *[f"_{p}{i}" for i in range(len(classes)) for p in ("mean", "sd")])


def _numeric_logs_arrays(rows: DataFrame, model: DataFrame, attr: str, on: Sequence[str]) -> DataFrame:
    """The same for many classes: the model of the attribute as an array per row."""
    side = model.filter(F.col("attr") == attr).groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("mean", "sd", "width")))).alias("_g")
    )
    out = rows.join(side, list(on), "left") if on else rows.join(side)
    x = F.col(attr).cast("double")

    def log_mass(c: Column) -> Column:
        g = F.try_element_at("_g", c["label"])
        grid = F.floor(x / g["width"] + 0.5) * g["width"]
        return F.log(F.greatest(normal_interval(grid, g["mean"], g["sd"], g["width"]), F.lit(LIKELIHOOD_FLOOR)))

    return out.withColumn("_lk", F.when(x.isNotNull() & F.col("_g").isNotNull(), F.transform("_pr", log_mass))).drop("_g")


def naive_bayes_score(
    df: DataFrame,
    prior: DataFrame,
    nominal: DataFrame | None,
    nominal_attrs: Sequence[str],
    numeric: DataFrame | None = None,
    numeric_attrs: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``classes`` and ``probs`` arrays: prior times likelihoods, normalised.

    The model is folded to one array of log likelihoods per (attr, value); each
    attribute is one equi-join that keeps the rows of ``df``, so rows are neither
    exploded nor regrouped.  Missing or never-listed values add nothing.
    """
    on = list(by)
    base = prior.groupBy(*on).agg(
        F.sort_array(F.collect_list(F.struct("label", F.log("prior").alias("lp")))).alias("_pr")
    )
    out = df.join(base, on) if on else df.join(base)
    out = out.withColumn("_s", F.transform("_pr", lambda r: r["lp"]))

    def added(cond, logs):
        return F.when(cond, F.zip_with("_s", logs, lambda a, b: a + F.coalesce(b, F.lit(0.0)))).otherwise(F.col("_s"))

    if nominal is not None:
        rows = nominal.groupBy(*on, "attr", "value").agg(
            F.sort_array(F.collect_list(F.struct("label", F.log(F.greatest("p", F.lit(LIKELIHOOD_FLOOR))).alias("lp")))).alias("_m")
        )
        for a in nominal_attrs:
            side = rows.filter(F.col("attr") == a).select(*on, F.col("value").alias("_v"), F.transform("_m", lambda r: r["lp"]).alias("_l"))
            cond = [F.col(f"_q{i}") == F.col(b) for i, b in enumerate(on)] + [F.col("_v") == F.col(a).cast("string")]
            side = side.select(*[F.col(b).alias(f"_q{i}") for i, b in enumerate(on)], "_v", "_l")
            out = out.join(side, cond, "left")
            out = out.withColumn("_s", added(F.col("_l").isNotNull(), F.col("_l"))).drop("_v", "_l", *[f"_q{i}" for i in range(len(on))])
    if numeric is not None:
        classes = [r["label"] for r in prior.select("label").distinct().orderBy("label").limit(MAX_UNROLLED + 1).collect()]
        for a in numeric_attrs:
            if len(classes) <= MAX_UNROLLED:
                out = _numeric_logs(out, numeric, a, classes, on)
            else:
                out = _numeric_logs_arrays(out, numeric, a, on)
            out = out.withColumn("_s", added(F.col("_lk").isNotNull(), F.col("_lk"))).drop("_lk")
    return out.withColumn("classes", F.transform("_pr", lambda r: r["label"])).withColumn("probs", softmax(F.col("_s"))).drop("_pr", "_s")


def predicted(probs: str = "probs", classes: str = "classes"):
    """Class of the largest probability; ties go to the first class in order."""
    rounded = F.transform(F.col(probs), lambda p: F.round(p, 9))
    return F.element_at(F.col(classes), F.array_position(rounded, F.array_max(rounded)).cast("int"))


def naive_bayes_fit(
    df: DataFrame,
    nominal_attrs: Sequence[str],
    numeric_attrs: Sequence[str] = (),
    label: str = "label",
    by: Sequence[str] = (),
) -> dict[str, DataFrame | None]:
    """Prior, nominal and numeric model tables, written once.

    Class counts travel as one more attribute, so nominal models and the prior come
    from one pass.  The tables are small; writing them keeps scoring from
    repeating the pass for every attribute.
    """
    clean = df.filter(F.col(label).isNotNull())
    whole = clean.withColumn(CLASS_ATTR, F.lit("1"))
    counts = cut(contingency(whole, [CLASS_ATTR, *nominal_attrs], label, by))
    seen = counts.filter(F.col("attr") == CLASS_ATTR).select(*by, "label", F.col("w").alias("n"))
    domain = seen.select("label").distinct()
    grid = seen.select(*by).distinct().join(domain) if by else domain
    prior = grid.join(seen, [*by, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + 1.0)
    prior = prior.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))
    nominal = numeric = None
    if nominal_attrs:
        counts = counts.filter(F.col("attr") != CLASS_ATTR)
        nominal = cut(nominal_model(counts, counts.select("attr", "value").distinct(), by))
    if numeric_attrs:
        numeric = cut(numeric_model(clean, numeric_attrs, label, by))
    return {"prior": prior, "nominal": nominal, "numeric": numeric}


def kernel_density_model(train: DataFrame, query: DataFrame, attrs: Sequence[str], label: str = "label", rows: int = 4_096) -> DataFrame:
    """Kernel estimator instead of one normal: ``(attr, value, label, p)`` for the
    distinct values of ``query``, usable like a nominal model.

    Each training value is a normal with deviation ``range / sqrt(n)`` of its class
    (at least a sixth of the value gap).  Distinct values meet in blocks that
    return partial sums, so no pair of values is written.
    """
    clean = train.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    number = [F.col(a).cast("double").alias(a) for a in attrs]
    long = clean.unpivot(["label"], number, "attr", "value").filter(F.col("value").isNotNull())
    known = long.groupBy("attr", "label", "value").agg(F.count(F.lit(1)).cast("double").alias("w"))
    spread = known.groupBy("attr").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("value").alias("d"))
    width = spread.select("attr", F.when(F.col("d") > 1, (F.col("hi") - F.col("lo")) / (F.col("d") - 1)).otherwise(DEFAULT_PRECISION).alias("width"))
    stats = known.groupBy("attr", "label").agg(F.sum("w").alias("n"), (F.max("value") - F.min("value")).alias("range"))
    side = known.join(cut(stats), ["attr", "label"]).join(cut(width), "attr")
    side = side.withColumn("sd", F.greatest(F.col("range") / F.sqrt("n"), F.col("width") / 6))
    asked = query.unpivot([], number, "attr", "value").filter(F.col("value").isNotNull()).distinct()

    def partial(q, t):
        out = []
        for attr, qa in q.groupby("attr"):
            ta = t[t["attr"] == attr]
            for lab, tl in ta.groupby("label"):
                x = qa["value"].to_numpy(float)[:, None]
                v, sd, w = (tl[c].to_numpy(float)[None, :] for c in ("value", "sd", "width"))
                pdf = lambda p: np.exp(-0.5 * ((p - v) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
                h = w / 4
                mass = (2 * h / 45) * (7 * pdf(x - 2 * h) + 32 * pdf(x - h) + 12 * pdf(x) + 32 * pdf(x + h) + 7 * pdf(x + 2 * h))
                out.append(pd.DataFrame({"attr": attr, "value": qa["value"].to_numpy(), "label": lab, "part": mass @ (tl["w"] / tl["n"]).to_numpy(float)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("attr", "value", "label", "part")})

    kind = dict(side.dtypes)["label"]
    parts = pair_blocks(asked, side, ["attr", "value"], ["attr", "label", "value"], partial, f"attr string, value double, label {kind}, part double", rows)
    return parts.groupBy("attr", "value", "label").agg(F.sum("part").alias("p")).withColumn("value", F.col("value").cast("string"))
