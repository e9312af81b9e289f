"""Folds, cross-validation and averaged result tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import best_label, seeded_hash
from strandlab.operators.bayes import CLASS_ATTR, naive_bayes_score, nominal_model, predicted
from strandlab.operators.counts import combine_counts, contingency
from strandlab.operators.ordering import seeded_rank
from strandlab.session import cut


def assign_folds(
    df: DataFrame,
    k: int = 10,
    seed: int | str | Column = 0,
    row_id: str = "id",
    label: str | None = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``fold`` in 0..k-1: shuffled by a seeded hash, stratified by class."""
    keys = [*by, *([label] if label else [])]
    hashed = df.withColumn("_h", seeded_hash(F.col(row_id), seed))
    ranked = seeded_rank(hashed, keys or ["_all"], "_h", row_id, "_rank") if keys else seeded_rank(
        hashed.withColumn("_all", F.lit(0)), ["_all"], "_h", row_id, "_rank"
    ).drop("_all")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_h", "_rank")


def train_side(df: DataFrame, fold: int) -> DataFrame:
    """All rows except the test fold."""
    return df.filter(F.col("fold") != fold)


def all_but_fold(fold_counts: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Training counts of every fold = total counts - counts of that fold."""
    total = fold_counts.groupBy("attr", "value", "label").agg(F.sum("w").alias("w"))
    folds = fold_counts.select(*by).distinct()
    return combine_counts(folds.join(total), fold_counts, -1, by)


def fold_models(folded: DataFrame, attrs: Sequence[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Prior and nominal model trained on all folds but ``fold``, for every fold.

    One pass counts attribute values and classes per fold; both tables are derived
    from these counts and written once.
    """
    every = cut(contingency(folded.withColumn(CLASS_ATTR, F.lit("1")), [CLASS_ATTR, *attrs], label, ["fold"]))
    counts, per_fold = every.filter(F.col("attr") != CLASS_ATTR), every.filter(F.col("attr") == CLASS_ATTR)
    model = cut(nominal_model(all_but_fold(counts), counts.select("attr", "value").distinct(), ["fold"]))
    per_fold = per_fold.select("fold", "label", F.col("w").alias("n"))
    total = per_fold.groupBy("label").agg(F.sum("n").alias("n_all"))
    grid = per_fold.select("fold").distinct().join(total).join(per_fold, ["fold", "label"], "left")
    prior = grid.withColumn("n", F.col("n_all") - F.coalesce("n", F.lit(0.0)) + 1.0)
    prior = prior.select("fold", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("fold"))).alias("prior"))
    return prior, model


def cross_validate_bayes(df: DataFrame, attrs: Sequence[str], k: int = 10, seed: int = 0, row_id: str = "id") -> DataFrame:
    """Out-of-fold naive Bayes predictions of one run, all folds in one job.

    Fold counts are taken once; the training table of a fold is the total minus
    the fold, so the data is scanned once for fitting and once for scoring.
    """
    folded = assign_folds(df, k, seed, row_id)
    prior, model = fold_models(folded, attrs)
    scored = naive_bayes_score(folded, prior.select("fold", "label", "prior"), model, attrs, by=["fold"])
    return scored.withColumn("predicted", predicted())


def fold_errors(preds: DataFrame, keys: Sequence[str], actual: str = "label", pred: str = "predicted") -> DataFrame:
    """One result row per key: rows and error rate."""
    wrong = F.when(F.col(actual) == F.col(pred), 0.0).otherwise(1.0)
    return preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("error"))


def run_grid(
    cells: Iterable[dict], compute: Callable[[dict], DataFrame], keys: Sequence[str]
) -> tuple[DataFrame | None, list[dict]]:
    """Evaluate every cell of a dataset x run x setting product.

    A failing cell is reported with its message and does not stop the others.
    Settings that are columns should go through ``by`` instead: one job for all.
    """
    done: DataFrame | None = None
    status: list[dict] = []
    for cell in cells:
        try:
            rows = compute(cell)
            # written here: a cell that fails while it runs is that cell's failure
            rows = cut(rows.withColumns({k: F.lit(cell[k]) for k in keys if k not in rows.columns}))
            done = rows if done is None else done.unionByName(rows)
            status.append({**cell, "status": "ok"})
        except Exception as error:  # noqa: BLE001 - the grid must go on
            status.append({**cell, "status": f"{type(error).__name__}: {error}"[:200]})
    return done, status


def average_results(
    results: DataFrame, keys: Sequence[str], metrics: Sequence[str], texts: Sequence[str] = (), std: bool = True
) -> DataFrame:
    """Mean (and sample deviation) per key; one null makes that mean null."""
    whole = F.count(F.lit(1))
    aggs = [whole.alias("results")]
    for m in metrics:
        full = F.count(m) == whole
        aggs.append(F.when(full, F.avg(m)).alias(f"avg_{m}"))
        if std:
            aggs.append(F.when(full, F.stddev_samp(m)).alias(f"sd_{m}"))
    aggs += [F.min(t).alias(t) for t in texts]
    return results.groupBy(*keys).agg(*aggs)


def average_violations(results: DataFrame, keys: Sequence[str], averaged: str, expected: int) -> DataFrame:
    """Groups whose averaged key repeats or whose result count is not ``expected``."""
    g = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("results"), F.countDistinct(averaged).alias("distinct_keys"))
    dup = F.col("distinct_keys") < F.col("results")
    return g.filter(dup | (F.col("results") != expected)).withColumn(
        "problem", F.when(dup, F.lit("duplicate key")).otherwise(F.lit("wrong count"))
    )


def cross_validate_rules(folded: DataFrame, attrs: Sequence[str], by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Fold errors of the one-attribute rules: ``(<by>, scheme, fold, n, error)``.

    Every attribute is a scheme.  Fitting and testing both happen on the fold
    counts: the rows are scanned once and never scored one by one.
    """
    keys = [*by, "attr", "value"]
    test = contingency(folded, attrs, label, [*by, "fold"]).withColumnRenamed("w", "test_w")
    total = test.groupBy(*keys, "label").agg(F.sum("test_w").alias("all_w"))
    folds = test.select("fold").distinct()
    grid = total.join(folds).join(test, [*keys, "label", "fold"], "left")
    grid = grid.withColumn("test_w", F.coalesce("test_w", F.lit(0.0)))
    rest = F.col("all_w") - F.col("test_w")
    per_value = grid.groupBy(*keys, "fold").agg(
        best_label(rest, F.col("label")).alias("predicted"),
        F.map_from_entries(F.collect_list(F.struct("label", "test_w"))).alias("hits"),
        F.sum("test_w").alias("tested"),
    )
    right = F.coalesce(F.try_element_at("hits", F.col("predicted")), F.lit(0.0))
    out = per_value.groupBy(*by, F.col("attr").alias("scheme"), "fold").agg(
        F.sum("tested").alias("n"), (1.0 - F.sum(right) / F.sum("tested")).alias("error")
    )
    return out.filter(F.col("n") > 0)
