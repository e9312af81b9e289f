"""Cross-validation of any learner over several runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions.exprs import best_label
from strandlab.operators.bayes import naive_bayes_score, predicted
from strandlab.plans.folds import assign_folds, fold_errors, fold_models
from strandlab.session import cut


class FoldLearner(Protocol):
    """A learner that predicts every row of ``folded`` from the rows of the other folds."""

    def out_of_fold(self, folded: DataFrame) -> DataFrame: ...


class NaiveBayes:
    """Nominal naive Bayes; a fold's training counts are all counts minus its own."""

    def __init__(self, attrs: Sequence[str]) -> None:
        self.attrs = list(attrs)

    def out_of_fold(self, folded: DataFrame) -> DataFrame:
        prior, model = fold_models(folded, self.attrs)
        return naive_bayes_score(folded, prior.select("fold", "label", "prior"), model, self.attrs, by=["fold"]).withColumn("predicted", predicted())


class OneAttribute:
    """Majority class per value of one attribute; a value that the other folds lack gets their majority."""

    def __init__(self, attr: str) -> None:
        self.attr = attr

    def out_of_fold(self, folded: DataFrame) -> DataFrame:
        cells = cut(folded.filter("label IS NOT NULL").groupBy("fold", F.col(self.attr).alias("_value"), "label").agg(F.count(F.lit(1)).alias("w")))
        folds = cells.select("fold").distinct()

        def majority(keys: Sequence[str], name: str) -> DataFrame:
            own = cells.groupBy("fold", *keys, "label").agg(F.sum("w").alias("own"))
            total = cells.groupBy(*keys, "label").agg(F.sum("w").alias("total"))
            # folds are few: every cell meets every fold once, on counts
            grid = total.withColumn("fold", F.explode(F.array(*[F.lit(r["fold"]) for r in folds.orderBy("fold").collect()]))) if folds.take(1) else total.withColumn("fold", F.lit(0))
            on = [grid[c].eqNullSafe(own[c]) for c in ("fold", *keys, "label")]
            rest = grid.join(own, on, "left").select(*[grid[c] for c in ("fold", *keys, "label")], (F.col("total") - F.coalesce("own", F.lit(0))).alias("w")).filter("w > 0")
            return cut(rest.groupBy("fold", *keys).agg(best_label(F.col("w"), F.col("label")).alias(name)))

        rules, default = majority(["_value"], "predicted"), majority([], "_default")
        out = folded.join(rules.withColumnRenamed("fold", "_fold"), (F.col("fold") == F.col("_fold")) & F.col(self.attr).eqNullSafe(F.col("_value")), "left").drop("_fold", "_value")
        return out.join(default, "fold", "left").withColumn("predicted", F.coalesce("predicted", "_default")).drop("_default")


def cross_validate(df: DataFrame, learners: Mapping[str, FoldLearner], runs: int = 1, k: int = 10, row_id: str = "id", label: str = "label") -> DataFrame:
    """Out-of-fold predictions ``(scheme, run, fold, row_id, label, predicted)``; every run deals its folds anew."""
    parts = []
    for run in range(runs):
        folded = cut(assign_folds(df.withColumnRenamed(label, "label"), k, run, row_id))
        for name, learner in learners.items():
            made = learner.out_of_fold(folded)
            parts.append(made.select(F.lit(name).alias("scheme"), F.lit(run).alias("run"), "fold", F.col(row_id).alias("row_id"), "label", "predicted"))
    return reduce(DataFrame.unionByName, parts)


def cross_validated_results(df: DataFrame, learners: Mapping[str, FoldLearner], runs: int = 1, k: int = 10, row_id: str = "id", label: str = "label") -> DataFrame:
    """Error of every ``(scheme, run, fold)``, as the result tables of this package hold it."""
    return fold_errors(cross_validate(df, learners, runs, k, row_id, label), ["scheme", "run", "fold"])
