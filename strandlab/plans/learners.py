"""Learners whose models follow from weighted counts.

``counts(<by>, attr, value, label, w)`` holds one more attribute, ``CLASS_ATTR``, that counts the classes.  Every column in
``by`` (bag, fold, iteration, grid point) is a model of its own, so one count table trains them all; a cell of weight
zero only says that the value and the class exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import best_label
from strandlab.operators.bayes import CLASS_ATTR, naive_bayes_score, predicted
from strandlab.operators.counts import contingency, info_gain
from strandlab.session import cut


class CountLearner(Protocol):
    """``fit`` turns counts into a model table ``(<by>, attr, value, label, p)``; ``score`` adds ``classes``, ``probs`` and ``predicted``."""

    attrs: Sequence[str]

    def fit(self, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame: ...

    def score(self, df: DataFrame, model: DataFrame, by: Sequence[str] = ()) -> DataFrame: ...


def class_counts(df: DataFrame, attrs: Sequence[str], label: str = "label", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts of the attribute values and of the classes, from one pass."""
    return contingency(df.withColumn(CLASS_ATTR, F.lit("1")), [CLASS_ATTR, *attrs], label, by, weight)


def counts_by_weight(df: DataFrame, attrs: Sequence[str], weights: Sequence[Column], key: str, label: str = "label") -> DataFrame:
    """One count table per weight, told apart by ``key`` = 0, 1, ...: every row is read once and never copied.

    All tables list every value and class of ``df``, with weight zero where the weights leave them out.
    """
    clean = df.filter(F.col(label).isNotNull()).withColumn("_w", F.array(*[w.cast("double") for w in weights]))
    ids = [F.col(label).alias("label"), F.col("_w")]
    long = clean.withColumn(CLASS_ATTR, F.lit("1")).unpivot(ids, [F.col(f"`{a}`").cast("string").alias(a) for a in (CLASS_ATTR, *attrs)], "attr", "value").filter("value IS NOT NULL")
    sums = long.groupBy("attr", "value", "label").agg(F.array(*[F.sum(F.col("_w")[i]) for i in range(len(weights))]).alias("_w"))
    return sums.select(F.posexplode("_w").alias(key, "w"), "attr", "value", "label")


def fold_training_counts(folded: DataFrame, attrs: Sequence[str], k: int, label: str = "label", weight: str | None = None) -> DataFrame:
    """Counts of all folds but ``fold``, for every fold: total minus own, from one pass."""
    own = class_counts(folded, attrs, label, ["fold"], weight)
    total = own.groupBy("attr", "value", "label").agg(F.map_from_entries(F.collect_list(F.struct("fold", "w"))).alias("_own"), F.sum("w").alias("_all"))  # at most k entries
    grid = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return grid.select("fold", "attr", "value", "label", (F.col("_all") - F.coalesce(F.try_element_at("_own", F.col("fold")), F.lit(0.0))).alias("w"))


class NaiveBayes:
    """Nominal naive Bayes with ``smooth`` extra counts per value and, if ``top`` is given, the ``top`` attributes of largest gain.

    Both may name a column of ``by``: then every grid point has its own.
    """

    def __init__(self, attrs: Sequence[str], smooth: float | str = 1.0, top: int | str | None = None) -> None:
        self.attrs, self.smooth, self.top = list(attrs), smooth, top

    def fit(self, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        keys = list(by)
        extra = F.col(self.smooth) if isinstance(self.smooth, str) else F.lit(float(self.smooth))
        classes = counts.filter(F.col("attr") == CLASS_ATTR)
        share = (F.col("w") + 1.0) / F.sum(F.col("w") + 1.0).over(Window.partitionBy(*(keys or [F.lit(0)])))
        prior = classes.select(*keys, "attr", "value", "label", share.alias("p"))
        values = counts.filter(F.col("attr").isin(self.attrs))
        if self.top is not None:
            order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.round("gain", 9).desc(), "attr")
            limit = F.col(self.top) if isinstance(self.top, str) else F.lit(self.top)
            kept = info_gain(values.filter("w > 0"), keys).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit)  # one row per attribute
            values = values.join(kept.select(*keys, "attr"), [*keys, "attr"], "left_semi")
        grid = classes.select(*keys, "label").join(values.select(*keys, "attr", "value").distinct(), keys) if keys else classes.select("label").join(values.select("attr", "value").distinct())
        full = grid.join(values, [*keys, "attr", "value", "label"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + extra)
        p = F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "attr", "label"))
        return prior.unionByName(full.select(*keys, "attr", "value", "label", p.alias("p")))

    def score(self, df: DataFrame, model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        prior = model.filter(F.col("attr") == CLASS_ATTR).select(*by, "label", F.col("p").alias("prior"))
        out = naive_bayes_score(df, prior, model.filter(F.col("attr") != CLASS_ATTR), self.attrs, by=by)
        return out.withColumn("predicted", predicted())


class OneAttribute:
    """Majority class per value of one attribute; a value without counts, or a missing one, gets the overall majority."""

    def __init__(self, attr: str) -> None:
        self.attr, self.attrs = attr, [attr]

    def fit(self, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        own = counts.filter(F.col("attr").isin(CLASS_ATTR, self.attr))
        best = own.groupBy(*by, "attr", "value").agg(F.sum("w").alias("_n"), best_label(F.col("w"), F.col("label")).alias("_best"))
        kept = best.filter((F.col("_n") > 0) | (F.col("attr") == CLASS_ATTR)).select(*by, "attr", "value", "_best")
        classes = counts.filter(F.col("attr") == CLASS_ATTR).select(*by, "label")
        grid = kept.join(classes, list(by)) if by else kept.join(classes)
        return grid.select(*by, "attr", "value", "label", (F.col("label") == F.col("_best")).cast("double").alias("p"))

    def score(self, df: DataFrame, model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows = model.groupBy(*by, "attr", "value").agg(F.array_sort(F.collect_list(F.struct("label", "p"))).alias("_z"))
        default = rows.filter(F.col("attr") == CLASS_ATTR).select(*by, F.col("_z").alias("_default"))
        rules = rows.filter(F.col("attr") == self.attr).select(*[F.col(b).alias(f"_q{i}") for i, b in enumerate(by)], F.col("value").alias("_v"), "_z")
        out = df.join(default, list(by)) if by else df.join(default)
        out = out.join(rules, [F.col(f"_q{i}") == F.col(b) for i, b in enumerate(by)] + [F.col("_v") == F.col(self.attr).cast("string")], "left")
        out = out.withColumn("_z", F.coalesce("_z", "_default")).withColumns({"classes": F.transform("_z", lambda z: z["label"]), "probs": F.transform("_z", lambda z: z["p"])})
        return out.withColumn("predicted", predicted()).drop("_z", "_default", "_v", *[f"_q{i}" for i in range(len(by))])


def train(df: DataFrame, learner: CountLearner, label: str = "label") -> DataFrame:
    """The learner's model on all rows, written once."""
    return cut(learner.fit(cut(class_counts(df, learner.attrs, label))))
