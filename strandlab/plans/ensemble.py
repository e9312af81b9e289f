"""Bagging, stacking and bias-variance over count learners."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import best_label, poisson_draw, seeded_hash, seeded_uniform
from strandlab.operators.rules import MISSING
from strandlab.plans.folds import assign_folds, cross_validate_bayes
from strandlab.plans.learners import CountLearner, class_counts, counts_by_weight, fold_training_counts, train
from strandlab.session import cut


class AttributeRule:
    """Majority class per value of one attribute; unseen values get the overall majority."""

    def __init__(self, attr: str, label: str = "label") -> None:
        self.attr, self.label = attr, label

    def fit(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        clean = df.filter(F.col(self.label).isNotNull())
        counts = clean.groupBy(*by, F.col(self.attr).alias("value"), F.col(self.label).alias("label")).agg(F.count(F.lit(1)).alias("w"))
        rules = counts.groupBy(*by, "value").agg(best_label(F.col("w"), F.col("label")).alias("predicted"))
        overall = counts.groupBy(*by, "label").agg(F.sum("w").alias("w"))
        default = overall.groupBy(*by).agg(best_label(F.col("w"), F.col("label")).alias("fallback"))
        return cut(rules.join(default, list(by)) if by else rules.join(default))

    def score(self, df: DataFrame, model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rules = model.select(*by, F.col("value").alias(self.attr), "predicted")
        default = model.select(*by, "fallback").distinct()
        out = df.join(rules, [*by, self.attr], "left")
        out = out.join(default, list(by)) if by else out.join(default)
        return out.withColumn("predicted", F.coalesce("predicted", "fallback")).drop("fallback")


def bag_weights(df: DataFrame, bags: int, pct: float = 100.0, row_id: str = "id", seed: int = 0) -> DataFrame:
    """Copies of a row in every bag: ``bag`` and Poisson weight ``bw`` > 0.

    The draw is a hash of (row, bag, seed): it does not depend on partitioning.
    """
    out = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    u = seeded_uniform(F.col(row_id), F.concat(F.lit(f"{seed}:"), F.col("bag").cast("string")))
    drawn = out.filter(u >= F.lit(math.exp(-pct / 100.0)))  # weight > 0; on the weight, the filter would hash once for each of its steps
    return drawn.withColumn("bw", poisson_draw(u, pct / 100.0))


def bagging(df: DataFrame, test: DataFrame, learner: CountLearner, bags: int = 10, pct: float = 100.0, row_id: str = "id", label: str = "label", seed: int = 0, vote: bool = False) -> DataFrame:
    """Bagged learner: ``test`` with ``classes`` and ``probs`` averaged over the bags (``vote``: shares of the votes).

    A bag is a weight per row, so all bags are counted by one aggregate that reads each row once.  The models meet the
    distinct attribute combinations of ``test``, not its rows; a combination is scored once per bag.
    """
    drawn = [poisson_draw(seeded_uniform(F.col(row_id), f"{seed}:{bag}"), pct / 100.0) for bag in range(bags)]
    model = cut(learner.fit(cut(counts_by_weight(df, learner.attrs, drawn, "bag", label)), ["bag"]))
    cells = test.select(*learner.attrs).distinct().withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    scored = learner.score(cells, model, ["bag"])
    probs = F.col("probs")
    if vote:
        probs = F.transform("classes", lambda c: (c == F.col("predicted")).cast("double"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("bag", probs.alias("p")))), lambda e: e["p"])  # one array per bag
    mean = scored.groupBy(*learner.attrs).agg(F.first("classes").alias("classes"), every.alias("_p"))
    summed = F.aggregate("_p", F.transform("classes", lambda c: F.lit(0.0)), lambda s, p: F.zip_with(s, p, lambda x, y: x + y))
    mean = cut(mean.select(*[F.col(a).alias(f"_c{i}") for i, a in enumerate(learner.attrs)], "classes", F.transform(summed, lambda v: v / bags).alias("probs")))
    met = [F.col(a).eqNullSafe(F.col(f"_c{i}")) for i, a in enumerate(learner.attrs)]
    return test.join(mean, met).drop(*[f"_c{i}" for i in range(len(learner.attrs))])


def bagged_mean(df: DataFrame, target: str, by: Sequence[str], bags: int = 10, pct: float = 100.0, row_id: str = "id", seed: int = 0) -> DataFrame:
    """Numeric class: mean over bags of the per-group weighted means."""
    w = bag_weights(df, bags, pct, row_id, seed)
    per_bag = w.groupBy(*by, "bag").agg((F.sum(F.col("bw") * F.col(target)) / F.sum("bw")).alias("m"))
    return per_bag.groupBy(*by).agg(F.avg("m").alias("predicted"))


def stack_out_of_fold(df: DataFrame, attrs: Sequence[str], classes: Sequence[str], k: int = 10, seed: int = 0, row_id: str = "id") -> DataFrame:
    """Out-of-fold class probabilities as features for a second learner."""
    scored = cross_validate_bayes(df, attrs, k, seed, row_id)
    probs = F.map_from_arrays("classes", "probs")
    return scored.select(row_id, "label", "fold", *[F.try_element_at(probs, F.lit(c)).alias(f"p_{c}") for c in classes])


class Stack:
    """Two stages: base learners, and a second learner over their scores.

    A base learner's score of a class is a feature of the second stage, as one of ``levels`` equal steps of the
    probability, so any count learner can be second; ``second`` makes it from the feature names.
    """

    def __init__(self, base: Mapping[str, CountLearner], second: Callable[[list[str]], CountLearner], classes: Sequence[str], levels: int = 10) -> None:
        self.base, self.classes, self.levels = dict(base), list(classes), levels
        self.features = [f"{name}_{c}" for name in self.base for c in self.classes]
        self.second = second(self.features)

    def _features(self, df: DataFrame, models: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
        for name, learner in self.base.items():
            scored = learner.score(df, models[name], by)
            probs = F.map_from_arrays("classes", "probs")
            step = {f"{name}_{c}": F.least(F.lit(self.levels - 1), F.floor(F.round(F.coalesce(F.try_element_at(probs, F.lit(c)), F.lit(0.0)), 9) * self.levels)).cast("string") for c in self.classes}
            df = scored.withColumns(step).drop("classes", "probs", "predicted")
        return df

    def fit(self, df: DataFrame, k: int = 10, seed: int = 0, row_id: str = "id", label: str = "label") -> dict[str, DataFrame]:
        """Models of both stages.

        The second stage learns from scores that base learners gave to rows of a fold they had not seen; the base
        learners kept for scoring have seen all rows.  One pass counts every base learner's attributes by fold.
        """
        folded = cut(assign_folds(df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label"), k, seed, row_id))
        attrs = sorted({a for learner in self.base.values() for a in learner.attrs})
        per_fold = cut(fold_training_counts(folded, attrs, k))
        out_of_fold = {name: cut(learner.fit(per_fold, ["fold"])) for name, learner in self.base.items()}
        total = per_fold.groupBy("attr", "value", "label").agg((F.sum("w") / (k - 1)).alias("w"))  # each row is in the counts of k - 1 folds
        models = {name: cut(learner.fit(total)) for name, learner in self.base.items()}
        return models | {"": train(self._features(folded, out_of_fold, ["fold"]), self.second)}

    def score(self, df: DataFrame, models: Mapping[str, DataFrame]) -> DataFrame:
        """``df`` with the features of the first stage and ``classes``, ``probs`` and ``predicted`` of the second."""
        return self.second.score(self._features(df, models), models[""])


def bias_variance_votes(df: DataFrame, learner: CountLearner, iterations: int = 50, pool: int = 100, row_id: str = "id", seed: int = 0) -> DataFrame:
    """Votes ``(<attrs>, label, w, iter, predicted)`` of a learner fitted on random halves of a pool.

    The pool is the first ``pool`` rows in seeded order, found without ordering the others; the test side is everything
    else.  Test rows with the same attribute values share all predictions and are counted once per class.
    """
    total = df.count()
    if total < 2 * pool:
        raise ValueError(f"needs at least {2 * pool} rows, found {total}")
    chosen = cut(df.withColumn("_h", seeded_hash(F.col(row_id), seed)).orderBy("_h", row_id).limit(pool))  # pool rows
    drawn = chosen.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    drawn = drawn.withColumn("_h2", seeded_hash(F.col(row_id), F.concat(F.lit(f"{seed}:"), F.col("iter").cast("string"))))
    half = F.row_number().over(Window.partitionBy("iter").orderBy("_h2", row_id))  # ``pool`` rows each
    drawn = drawn.withColumn("_k", half).filter(F.col("_k") <= pool // 2)
    model = cut(learner.fit(cut(class_counts(drawn, learner.attrs, by=["iter"])), ["iter"]))
    rest = df.join(F.broadcast(chosen.select(row_id)), row_id, "left_anti")
    cells = cut(rest.filter("label IS NOT NULL").groupBy(*learner.attrs, "label").agg(F.count(F.lit(1)).cast("double").alias("w")))
    grid = cells.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    cell = F.concat_ws("\0", *[F.coalesce(F.col(a).cast("string"), F.lit(MISSING)) for a in learner.attrs])
    return learner.score(grid, model, ["iter"]).select(cell.alias("cell"), "label", "w", "iter", "predicted")
