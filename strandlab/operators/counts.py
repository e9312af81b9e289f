"""Contingency tables and everything read off them.

``counts(<by>, attr, value, label, w)`` comes from one unpivot and one partial
aggregate; its size is bounded by attributes x values x classes, so all split
criteria below work on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import best_label, safe_div, xlog2
from strandlab.operators.ordering import PIECE_ROWS, running_totals
from strandlab.session import cut


def to_long(
    df: DataFrame, attrs: Sequence[str], keep: Sequence[str] = ("label",), weight: str | None = None
) -> DataFrame:
    """``(<keep>, attr, value[, w])`` with one row per non-null attribute value."""
    ids = [F.col(k) for k in keep]
    if weight:
        ids.append(F.col(weight).cast("double").alias("w"))
    long = df.unpivot(ids, [F.col(a).cast("string").alias(a) for a in attrs], "attr", "value")
    return long.filter(F.col("value").isNotNull())


def contingency(
    df: DataFrame,
    attrs: Sequence[str],
    label: str = "label",
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Weight per (by, attr, value, label); rows with a null class are left out."""
    src = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    w = F.sum("w") if weight else F.count(F.lit(1)).cast("double")
    return to_long(src, attrs, [*by, "label"], weight).groupBy(*by, "attr", "value", "label").agg(w.alias("w"))


def combine_counts(a: DataFrame, b: DataFrame, sign: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Add (or subtract, ``sign=-1``) two contingency tables bag by bag."""
    keys = [*by, "attr", "value", "label"]
    signed = b.select(*keys, (F.col("w") * sign).alias("w"))
    out = a.select(*keys, "w").unionByName(signed).groupBy(*keys).agg(F.sum("w").alias("w"))
    return out.filter(F.abs(F.col("w")) > 1e-9)


def shift_rows(counts: DataFrame, moved: DataFrame, to_value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Move the rows counted in ``moved`` from their bag to the bag ``to_value``."""
    out = combine_counts(counts, moved, -1, by)
    return combine_counts(out, moved.withColumn("value", to_value), 1, by)


def contingency_with_missing(
    df: DataFrame, attrs: Sequence[str], label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Counts where rows lacking the attribute are spread in proportion to bag weight."""
    known = contingency(df, attrs, label, by)
    src = df.filter(F.col(label).isNotNull())
    missing = (
        src.groupBy(*by, F.col(label).alias("label"))
        .agg(*[F.count_if(F.col(a).isNull()).cast("double").alias(a) for a in attrs])
        .unpivot([*by, "label"], list(attrs), "attr", "miss")
        .filter(F.col("miss") > 0)
    )
    bags = known.groupBy(*by, "attr", "value").agg(F.sum("w").alias("bag"))
    share = bags.withColumn("share", F.col("bag") / F.sum("bag").over(Window.partitionBy(*by, "attr")))
    spread = share.join(missing, [*by, "attr"]).select(
        *by, "attr", "value", "label", (F.col("share") * F.col("miss")).alias("w")
    )
    return combine_counts(known, spread, 1, by)


def majority_baseline(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Class prior with one extra count per class of the whole domain."""
    clean = df.filter(F.col(label).isNotNull())
    domain = clean.select(F.col(label).alias("label")).distinct()
    groups = clean.select(*by).distinct().join(domain) if by else domain
    seen = clean.groupBy(*by, F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    full = groups.join(seen, [*by, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + 1.0)
    return full.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def majority_predict(prior: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return prior.groupBy(*by).agg(best_label(F.col("n"), F.col("label")).alias("predicted"))


def mean_baseline(df: DataFrame, target: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Numeric class: the weighted mean."""
    w = F.when(F.col(target).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    return df.groupBy(*by).agg(safe_div(F.sum(w * F.col(target)), F.sum(w)).alias("predicted"))


# -- entropy and splits -------------------------------------------------------

ALL_ROWS = "\u0000rows"  # constant attribute that counts all rows by class


def _entropy_terms(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (by, attr): total, class and bag sums of w*log2(w)."""
    keys = [*by, "attr"]
    cells = counts.groupBy(*keys).agg(F.sum("w").alias("known"), F.sum(xlog2(F.col("w"))).alias("cell_sum"))
    bags = (
        counts.groupBy(*keys, "value")
        .agg(F.sum("w").alias("w"))
        .groupBy(*keys)
        .agg(F.sum(xlog2(F.col("w"))).alias("bag_sum"), F.count(F.lit(1)).alias("bags"))
    )
    classes = (
        counts.groupBy(*keys, "label")
        .agg(F.sum("w").alias("w"))
        .groupBy(*keys)
        .agg(F.sum(xlog2(F.col("w"))).alias("class_sum"))
    )
    return cells.join(bags, keys).join(classes, keys)


def info_gain(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class entropy, conditional entropy and gain of every nominal attribute."""
    t = _entropy_terms(counts, by)
    n = F.col("known")
    before = (xlog2(n) - F.col("class_sum")) / n
    after = (F.col("bag_sum") - F.col("cell_sum")) / n
    return t.select(
        *by, "attr", before.alias("entropy"), after.alias("cond_entropy"), (before - after).alias("gain")
    )


def split_nominal_multiway(
    counts: DataFrame, totals: DataFrame, min_obj: float = 2.0, by: Sequence[str] = ()
) -> DataFrame:
    """Gain and gain ratio of the one-bag-per-value split.

    ``totals(<by>, total)`` counts all rows, missing values included: the gain is
    scaled by the known share and missing rows form a bag of the split entropy.
    Attributes without two bags of ``min_obj`` rows give no split.
    """
    big = (
        counts.groupBy(*by, "attr", "value")
        .agg(F.sum("w").alias("w"))
        .groupBy(*by, "attr")
        .agg(F.count_if(F.col("w") >= min_obj).alias("big"))
        .filter(F.col("big") >= 2)
    )
    t = _entropy_terms(counts, by).join(big, [*by, "attr"])
    t = t.join(totals, list(by)) if by else t.join(totals)
    n, total = F.col("known"), F.col("total")
    gain = (n / total) * (xlog2(n) - F.col("class_sum") - F.col("bag_sum") + F.col("cell_sum")) / n
    split = (xlog2(total) - F.col("bag_sum") - xlog2(total - n)) / total
    return t.select(
        *by,
        "attr",
        F.lit("multiway").alias("kind"),
        F.lit(None).cast("string").alias("point"),
        gain.alias("gain"),
        F.when(split > 0, gain / split).otherwise(F.lit(0.0)).alias("gain_ratio"),
    )


def split_nominal_binary(
    counts: DataFrame, totals: DataFrame, min_obj: float = 2.0, by: Sequence[str] = ()
) -> DataFrame:
    """Best one-value-against-the-rest split of every attribute by gain ratio."""
    keys = [*by, "attr"]
    class_totals = counts.groupBy(*keys, "label").agg(F.sum("w").alias("class_w"))
    values = counts.select(*keys, "value").distinct()
    grid = values.join(class_totals, keys).join(counts, [*keys, "value", "label"], "left")
    grid = grid.withColumn("w", F.coalesce("w", F.lit(0.0)))
    rest = F.col("class_w") - F.col("w")
    sides = grid.groupBy(*keys, "value").agg(
        F.sum("w").alias("in_w"),
        F.sum(rest).alias("out_w"),
        F.sum(xlog2(F.col("w")) + xlog2(rest)).alias("cell_sum"),
        F.sum(xlog2(F.col("class_w"))).alias("class_sum"),
    )
    sides = sides.filter((F.col("in_w") >= min_obj) & (F.col("out_w") >= min_obj))
    sides = sides.join(totals, list(by)) if by else sides.join(totals)
    n, total = F.col("in_w") + F.col("out_w"), F.col("total")
    bag_sum = xlog2(F.col("in_w")) + xlog2(F.col("out_w"))
    gain = (n / total) * (xlog2(n) - F.col("class_sum") - bag_sum + F.col("cell_sum")) / n
    split = (xlog2(total) - bag_sum - xlog2(total - n)) / total
    scored = sides.select(
        *keys, "value", gain.alias("gain"), F.when(split > 0, gain / split).otherwise(F.lit(0.0)).alias("gain_ratio")
    )
    best = scored.groupBy(*keys).agg(
        F.min(F.struct((-F.round("gain_ratio", 9)).alias("s"), "value", "gain", "gain_ratio")).alias("b")
    )
    return best.select(
        *keys,
        F.lit("binary").alias("kind"),
        F.col("b.value").alias("point"),
        F.col("b.gain").alias("gain"),
        F.col("b.gain_ratio").alias("gain_ratio"),
    )


def split_numeric(
    df: DataFrame,
    attrs: Sequence[str],
    label: str = "label",
    min_obj: float = 2.0,
    by: Sequence[str] = (),
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Best threshold of every numeric attribute.

    Cuts lie between distinct values more than 1e-5 apart with at least
    ``clamp(0.1 n / classes, min_obj, 25)`` rows on each side; the gain pays
    ``log2(cuts) / n``.  The midpoint is then moved down to the largest data
    value that does not exceed it.
    """
    keys = [*by, "attr"]
    clean = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label").withColumn(ALL_ROWS, F.lit(0.0))
    ids = [*[F.col(b) for b in by], F.col("label")]
    long = clean.unpivot(ids, [F.col(f"`{a}`").cast("double").alias(a) for a in (ALL_ROWS, *attrs)], "attr", "value").filter(F.col("value").isNotNull())
    # the only pass over the rows: everything else is read off the weights of distinct (value, class) pairs
    cells = cut(long.groupBy(*keys, "value", "label").agg(F.count(F.lit(1)).cast("double").alias("w")))
    totals = cells.filter(F.col("attr") == ALL_ROWS).groupBy(*by).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("classes"))
    values = cells.filter(F.col("attr") != ALL_ROWS)
    classes = cut(values.groupBy(*keys, "label").agg(F.sum("w").alias("t")))
    known = classes.groupBy(*keys).agg(F.sum("t").alias("known"))
    # moving a value to the left side changes the class sums of its own classes only
    moved = running_totals(values, [*keys, "label"], ["value"], {"left": F.col("w")}, piece_rows).join(classes, [*keys, "label"])
    left, right, w = F.col("left"), F.col("t") - F.col("left"), F.col("w")
    change = xlog2(left) - xlog2(left - w) + xlog2(right) - xlog2(right + w)
    per_value = cut(moved.groupBy(*keys, "value").agg(F.sum("w").alias("w"), F.sum(change).alias("change")))
    nexts = running_totals(per_value, keys, ["value"], {"in_w": F.col("w"), "cells": F.col("change")}, piece_rows, None, {"next_value": "value"})
    # sized tables of one row per attribute: the values are not shuffled again
    known, totals = cut(known), cut(totals)
    grid = nexts.join(known, keys)
    grid = grid.join(totals, list(by)) if by else grid.join(totals)

    in_w = F.col("in_w")
    out_w = F.col("known") - in_w
    floor = F.lit(0.1) * F.col("known") / F.col("classes")
    floor = F.when(floor <= min_obj, F.lit(float(min_obj))).when(floor > 25, F.lit(25.0)).otherwise(floor)
    n, total = F.col("known"), F.col("total")
    bag_sum = xlog2(in_w) + xlog2(out_w)
    gain = (n / total) * (xlog2(n) - bag_sum + F.col("cells")) / n  # the class sums of the start and of the whole cancel
    split = (xlog2(total) - bag_sum - xlog2(total - n)) / total
    cuts = grid.filter(
        (F.col("value") + 1e-5 < F.col("next_value")) & (in_w >= floor) & (out_w >= floor) & (n >= 2 * floor)
    ).select(*keys, "value", "next_value", "total", gain.alias("raw_gain"), split.alias("split_info"))
    best = cuts.groupBy(*keys).agg(
        F.min(
            F.struct((-F.round("raw_gain", 9)).alias("s"), "value", "next_value", "raw_gain", "split_info", "total")
        ).alias("b"),
        F.count(F.lit(1)).alias("cuts"),
    )
    fair = F.col("b.raw_gain") - F.log2(F.col("cuts").cast("double")) / F.col("b.total")
    # both neighbours are adjacent data values, so the largest value at or below
    # the midpoint is the lower one (the upper one only if rounding reaches it)
    middle = (F.col("b.value") + F.col("b.next_value")) / 2
    snapped = F.when(F.col("b.next_value") <= middle, F.col("b.next_value")).otherwise(F.col("b.value"))
    return best.select(
        *keys,
        F.lit("numeric").alias("kind"),
        snapped.alias("threshold"),
        F.col("cuts").cast("long").alias("cuts"),
        fair.alias("gain"),
        F.when(F.col("b.split_info") > 0, fair / F.col("b.split_info")).otherwise(F.lit(0.0)).alias("gain_ratio"),
    ).filter(F.col("gain") > 0)


def select_split(
    splits: DataFrame,
    totals: DataFrame,
    domains: DataFrame,
    min_obj: float = 2.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Choose one attribute per group.

    ``splits(<by>, attr, kind, point, gain, gain_ratio)``; ``totals(<by>, total,
    top_class)``; ``domains(attr, values)`` counts nominal values, null for
    numeric ones.  No split for small or pure groups.  Very wide nominal
    attributes do not enter the mean gain unless all attributes are wide.
    """
    on = list(by)
    t = splits.join(domains, "attr", "left")
    t = t.join(totals, on) if on else t.join(totals)
    t = t.filter((F.col("total") >= 2 * min_obj) & (F.col("total") != F.col("top_class")))
    all_wide = domains.agg(
        F.min(F.coalesce(F.col("values").cast("double"), F.lit(0.0))).alias("narrowest")
    )
    t = t.join(all_wide)
    counted = (F.coalesce(F.col("values"), F.lit(0)) < 0.3 * F.col("total")) | (
        F.col("narrowest") >= 0.3 * F.col("total")
    )
    group = Window.partitionBy(*(on or [F.lit(0)]))
    t = t.withColumn("mean_gain", F.avg(F.when(counted, F.col("gain"))).over(group))
    fit = t.filter((F.col("gain") >= F.col("mean_gain") - 1e-3) & (F.col("gain_ratio") > 1e-6))
    first = Window.partitionBy(*(on or [F.lit(0)])).orderBy(F.round("gain_ratio", 9).desc(), "attr", "kind")
    return fit.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(
        *on, "attr", "kind", "point", "gain", "gain_ratio"
    )


# -- one rule -----------------------------------------------------------------


def one_rule_nominal(df: DataFrame, attrs: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Per attribute the majority class of every value; missing is a value of its own.

    Returns ``(<by>, attr, value, predicted, correct, rule_correct, best)``.
    """
    src = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    filled = src.withColumns({a: F.coalesce(F.col(a).cast("string"), F.lit("?missing")) for a in attrs})
    counts = contingency(filled, attrs, "label", by)
    per_value = counts.groupBy(*by, "attr", "value").agg(
        best_label(F.col("w"), F.col("label")).alias("predicted"), F.max("w").alias("correct")
    )
    w = Window.partitionBy(*by, "attr")
    rules = per_value.withColumn("rule_correct", F.sum("correct").over(w))
    best = rules.groupBy(*by).agg(
        F.min(F.struct((-F.col("rule_correct")).alias("s"), F.col("attr")))["attr"].alias("_best")
    )
    joined = rules.join(best, list(by)) if by else rules.join(best)
    return joined.withColumn("best", F.col("attr") == F.col("_best")).drop("_best")
