"""Comparing predictions and result tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.tails import f_upper, t_two_sided


# -- predictions -----------------------------------------------------------------


def canonical(df: DataFrame, label_map: DataFrame, col: str) -> DataFrame:
    """Replace labels by the canonical name of their synonym entry."""
    m = label_map.select(F.col("label").alias("_l"), F.col("canonical").alias("_c"))
    return df.join(m, F.col(col) == F.col("_l"), "left").withColumn(col, F.coalesce("_c", col)).drop("_l", "_c")


def confusion_matrix(preds: DataFrame, classes: Sequence[str], label_map: DataFrame | None = None) -> DataFrame:
    """One row per actual class, one column per predicted class, and the error share; no prediction is an error."""
    p = preds.select("actual", "predicted")
    if label_map is not None:
        p = canonical(canonical(p, label_map, "actual"), label_map, "predicted")
    cells = p.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    wide = cells.groupBy("actual").agg(
        *[F.coalesce(F.sum(F.when(F.col("predicted") == c, F.col("n"))), F.lit(0)).alias(f"as_{c}") for c in classes],
        (F.coalesce(F.sum(F.when(~F.col("predicted").eqNullSafe(F.col("actual")), F.col("n"))), F.lit(0)) / F.sum("n")).alias("error"),
    )
    return wide


def error_by_setting(preds: DataFrame, keys: Sequence[str], path: str = "path", skip: Sequence[str] = ("prototype", "final")) -> DataFrame:
    """Error per setting parsed from the results path; helper copies are left out."""
    keep = preds
    for word in skip:
        keep = keep.filter(~F.contains(F.lower(F.col(path)), F.lit(word)))
    wrong = F.when(F.col("actual") == F.col("predicted"), 0.0).otherwise(1.0)
    return keep.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("error"))


def _by_row(preds: DataFrame) -> DataFrame:
    """All predictions of a row side by side: schemes are few, rows are many."""
    return preds.groupBy("row_id").agg(
        F.min("actual").alias("actual"), F.array_sort(F.collect_list(F.struct("scheme", "predicted"))).alias("s")
    )


def _scheme_pairs(rows: DataFrame) -> DataFrame:
    """One row per (row, first scheme, second scheme) in scheme order."""
    pairs = F.flatten(
        F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["scheme"] > a["scheme"]), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return rows.select("row_id", "actual", F.explode(pairs).alias("p"))


def agreement(preds: DataFrame) -> DataFrame:
    """Share of rows on which two schemes predict the same class."""
    p = _scheme_pairs(_by_row(preds))
    same = F.when(F.col("p.a.predicted") == F.col("p.b.predicted"), 1.0).otherwise(0.0)
    return p.groupBy(F.col("p.a.scheme").alias("scheme_x"), F.col("p.b.scheme").alias("scheme_y")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(same).alias("agreement")
    )


CHI_95 = 3.841459  # fixed value: 95 % point of chi-square with one degree of freedom


def outcome_table(preds: DataFrame) -> DataFrame:
    """2 x 2 table of right and wrong for every scheme pair; no prediction is wrong."""
    p = _scheme_pairs(_by_row(preds))
    x = F.coalesce(F.col("p.a.predicted") == F.col("actual"), F.lit(False))
    y = F.coalesce(F.col("p.b.predicted") == F.col("actual"), F.lit(False))
    return p.groupBy(F.col("p.a.scheme").alias("scheme_x"), F.col("p.b.scheme").alias("scheme_y")).agg(
        F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("only_x"), F.count_if(~x & y).alias("only_y"), F.count_if(~x & ~y).alias("both_wrong")
    )


def mcnemar(preds: DataFrame) -> DataFrame:
    """``(|b - c| - 1)^2 / (b + c)``; null when the schemes never differ in outcome."""
    t = outcome_table(preds)
    b, c = F.col("only_x"), F.col("only_y")
    stat = F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2.0) / (b + c))
    t = t.withColumn("statistic", stat)
    return t.withColumn("equivalent", F.coalesce(F.col("statistic") <= CHI_95, F.lit(True)))


def bootstrap_diff(table: DataFrame, draws: int = 10_000, level: float = 0.90, seed: int = 1) -> DataFrame:
    """Interval of the accuracy difference under resampling of the 2 x 2 table.

    A draw of n rows from four cells is one multinomial draw, so a draw costs the
    same for any number of test rows.  Draws are spread over tasks.
    """
    keys = ["scheme_x", "scheme_y"]
    cells = ["both_right", "only_x", "only_y", "both_wrong"]
    blocks = table.sparkSession.range(0, draws, 500).withColumnRenamed("id", "block")
    work = table.select(*keys, *cells).join(blocks).repartition(*keys, "block")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                counts = np.array([rec[c] for c in cells], dtype=float)
                n = int(counts.sum())
                if not n:
                    continue
                rng = np.random.default_rng([seed, int(rec["block"])])
                size = min(500, draws - int(rec["block"]))
                hit = rng.multinomial(n, counts / counts.sum(), size=size)
                yield pd.DataFrame({"scheme_x": rec["scheme_x"], "scheme_y": rec["scheme_y"], "diff": (hit[:, 1] - hit[:, 2]) / n})

    diffs = work.mapInPandas(sample, "scheme_x string, scheme_y string, diff double")
    tail = (1 - level) / 2
    out = diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"), F.percentile("diff", F.lit(tail)).alias("lower"), F.percentile("diff", F.lit(1 - tail)).alias("upper")
    )
    return out.withColumn("equivalent", F.col("lower") * F.col("upper") <= 0)


def relevant_binary_errors(reference: DataFrame, outputs: DataFrame, code: DataFrame) -> DataFrame:
    """Share of wrong binary outputs among the classifiers that matter for an error.

    ``reference(row_id, actual, predicted)`` are the predictions whose errors are
    studied, ``outputs(row_id, clf, bit)`` the binary decisions of another scheme.
    A classifier matters if it puts the two confused classes on different sides.
    """
    wrong = reference.filter(F.col("actual") != F.col("predicted"))
    a = code.select("clf", F.col("class").alias("actual"), F.col("bit").alias("want"))
    b = code.select("clf", F.col("class").alias("predicted"), F.col("bit").alias("other"))
    # classes are few: join the code with itself once, then one join per confused row
    confused = a.join(b, "clf").filter((F.col("want") * F.col("other")) == -1)
    rows = wrong.join(confused, ["actual", "predicted"]).join(outputs, ["row_id", "clf"])
    bad = F.when(F.col("bit") != F.col("want"), 1.0).otherwise(0.0)
    return rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("relevant"), F.avg(bad).alias("wrong_share"))


# -- result tables ---------------------------------------------------------------


def pair_results(results: DataFrame, metric: str, keys: Sequence[str] = ("dataset", "run", "fold")) -> DataFrame:
    """Metric of every two schemes on the same keys: ``(<keys>, scheme_x, scheme_y, x, y)``.

    The results of a key, one for each of few schemes, come together once and are paired inside that row.
    """
    known = results.filter(F.col("scheme").isNotNull()).dropna(subset=list(keys))
    rows = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("scheme", F.col(metric).alias("v")))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["scheme"] > a["scheme"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = rows.select(*keys, F.explode(pairs).alias("p"))
    return out.select(*keys, F.col("p.a.scheme").alias("scheme_x"), F.col("p.b.scheme").alias("scheme_y"), F.col("p.a.v").alias("x"), F.col("p.b.v").alias("y"))


def unpaired_results(results: DataFrame, keys: Sequence[str] = ("dataset", "run", "fold")) -> DataFrame:
    """Keys that some scheme of the same dataset lacks or repeats."""
    per_key = results.groupBy(*keys).agg(F.countDistinct("scheme").alias("schemes"), F.count(F.lit(1)).alias("rows"))
    want = results.groupBy("dataset").agg(F.countDistinct("scheme").alias("expected"))
    return per_key.join(want, "dataset").filter((F.col("schemes") != F.col("expected")) | (F.col("rows") != F.col("schemes")))


def _paired_stats(pairs: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    d = F.col("x") - F.col("y")
    g = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        F.stddev_samp("x").alias("sd_x"), F.stddev_samp("y").alias("sd_y"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"),
    )
    flat = F.col("sd_diff").isNull() | (F.round("sd_diff", 12) == 0)
    g = g.withColumn("t", F.when(~flat, F.col("mean_diff") * F.sqrt("n") / F.col("sd_diff")))
    p = t_two_sided(F.coalesce("t", F.lit(0.0)), F.greatest(F.col("n") - 1, F.lit(1)))
    g = g.withColumn("p", F.when(~flat, p).when(F.round("mean_diff", 12) == 0, 1.0).otherwise(0.0))
    sign = F.when(F.col("p") > alpha, 0).when(F.col("mean_x") > F.col("mean_y"), 1).otherwise(-1)
    return g.withColumn("significance", sign)


def paired_t(results: DataFrame, metric: str, alpha: float = 0.05, keys: Sequence[str] = ("dataset", "run", "fold")) -> DataFrame:
    """Paired t-test per dataset and scheme pair; ``significance`` is the sign of x - y or 0."""
    return _paired_stats(pair_results(results, metric, keys), ["dataset", "scheme_x", "scheme_y"], alpha)


def _both_ways(paired: DataFrame) -> DataFrame:
    """``(dataset, row, col, beats)``: beats is 1 when col is significantly above row."""
    a = paired.select("dataset", F.col("scheme_x").alias("row"), F.col("scheme_y").alias("col"), F.col("significance").alias("s"))
    flags = F.array(
        F.struct(F.col("row").alias("row"), F.col("col").alias("col"), F.when(F.col("s") < 0, 1).otherwise(0).alias("beats")),
        F.struct(F.col("col").alias("row"), F.col("row").alias("col"), F.when(F.col("s") > 0, 1).otherwise(0).alias("beats")),
    )
    return a.select("dataset", F.explode(flags).alias("z")).select("dataset", "z.row", "z.col", "z.beats")


def win_matrix(paired: DataFrame, schemes: Sequence[str]) -> DataFrame:
    """Datasets on which the column scheme is significantly above the row scheme."""
    b = _both_ways(paired)
    return b.groupBy("row").agg(*[F.coalesce(F.sum(F.when(F.col("col") == s, F.col("beats"))), F.lit(0)).alias(s) for s in schemes])


def rank_schemes(paired: DataFrame) -> DataFrame:
    """Wins, losses and their difference per scheme, best first."""
    b = _both_ways(paired)
    one = F.array(F.struct(F.col("col").alias("scheme"), F.col("beats").alias("w"), F.lit(0).alias("l")), F.struct(F.col("row").alias("scheme"), F.lit(0).alias("w"), F.col("beats").alias("l")))
    g = b.select(F.explode(one).alias("z")).groupBy("z.scheme").agg(F.sum("z.w").alias("wins"), F.sum("z.l").alias("losses"))
    return g.withColumn("diff", F.col("wins") - F.col("losses")).orderBy(F.col("diff").desc(), "scheme")


def comparison_table(results: DataFrame, metric: str, base: str, schemes: Sequence[str], alpha: float = 0.05, keys: Sequence[str] = ("dataset", "run", "fold")) -> DataFrame:
    """Per dataset: mean, deviation and mark of every scheme against ``base``.

    ``v`` is significantly above the base, ``*`` significantly below.
    """
    b = results.filter(F.col("scheme") == base).select(*keys, F.col(metric).alias("y"))
    pairs = results.join(b, list(keys)).withColumnRenamed(metric, "x")
    s = _paired_stats(pairs, ["dataset", "scheme"], alpha)
    mark = F.when(F.col("scheme") == base, "").when(F.col("significance") > 0, "v").when(F.col("significance") < 0, "*").otherwise("")
    s = s.withColumn("mark", mark)

    def of(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("scheme") == name, value))

    cols = []
    for name in schemes:
        cols += [of(name, F.col("mean_x")).alias(f"{name}_mean"), of(name, F.col("sd_x")).alias(f"{name}_sd"), of(name, F.col("mark")).alias(f"{name}_mark")]
    return s.groupBy("dataset").agg(*cols)


def win_tie_loss(results: DataFrame, metric: str, base: str, alpha: float = 0.05, keys: Sequence[str] = ("dataset", "run", "fold")) -> DataFrame:
    """Datasets on which a scheme is above, equal to or below the base."""
    b = results.filter(F.col("scheme") == base).select(*keys, F.col(metric).alias("y"))
    pairs = results.filter(F.col("scheme") != base).join(b, list(keys)).withColumnRenamed(metric, "x")
    s = _paired_stats(pairs, ["dataset", "scheme"], alpha)
    sig = F.col("significance")
    return s.groupBy("scheme").agg(F.count_if(sig > 0).alias("win"), F.count_if(sig == 0).alias("tie"), F.count_if(sig < 0).alias("loss"))


def distinct_specifiers(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.select(*keys).distinct()


def two_sample_t(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Pooled-variance t-test of ``value`` between the groups true and false of ``group``,
    with the variance-ratio test next to it."""
    a, b = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    g = df.groupBy(*by).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"), F.var_samp(a).alias("var1"), F.var_samp(b).alias("var2")
    )
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.coalesce("var1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("var2", F.lit(0.0))) / dof
    g = g.withColumn("df", dof).withColumn("t", F.when((dof > 0) & (pooled > 0), (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1.0 / F.col("n1") + 1.0 / F.col("n2")))))
    first = F.col("var1") > F.col("var2")
    big, small = F.greatest("var1", "var2"), F.least("var1", "var2")
    g = g.withColumn("f", F.when(small > 0, big / small))
    g = g.withColumns({"df1": F.when(first, F.col("n1")).otherwise(F.col("n2")) - 1, "df2": F.when(first, F.col("n2")).otherwise(F.col("n1")) - 1})
    two = 2.0 * f_upper(F.coalesce("f", F.lit(1.0)), F.greatest("df1", F.lit(1)), F.greatest("df2", F.lit(1)))
    g = g.withColumns({"p": t_two_sided(F.coalesce("t", F.lit(0.0)), F.greatest("df", F.lit(1))), "_f2": two})
    return g.withColumn("p_variance", F.when(F.col("_f2") > 1, 2.0 - F.col("_f2")).otherwise(F.col("_f2"))).drop("_f2", "df1", "df2")


def bias_variance(votes: DataFrame, iterations: int) -> DataFrame:
    """Bias, variance, sigma and error from ``(cell, label, w, iter, predicted)``.

    ``w`` is the number of test rows of the cell with that label; rows of a cell
    share their predictions, so frequencies are taken per cell.
    """
    freq = votes.groupBy("cell", "label", "w", "predicted").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.lit(float(iterations))
    hit = F.when(F.col("predicted") == F.col("label"), 1.0).otherwise(0.0)
    # a class without votes adds (actual - 0)^2, which only matters for the true class
    per = freq.groupBy("cell", "label", "w").agg(
        F.sum(F.pow(hit - p, 2.0) - p * (1 - p) / (iterations - 1)).alias("b"),
        F.max(hit).alias("seen"),
        F.sum(p * p).alias("v"),
        F.sum((1 - hit) * p).alias("err"),
    )
    b = F.col("b") + F.when(F.col("seen") == 0, 1.0).otherwise(0.0)
    n = F.sum("w")
    return per.agg(
        (F.sum(F.col("w") * b) / (2 * n)).alias("bias"),
        (F.sum(F.col("w") * (1 - F.col("v"))) / (2 * n)).alias("variance"),
        F.lit(0.0).alias("sigma"),
        (F.sum(F.col("w") * F.col("err")) / n).alias("error"),
    )


# -- attribute rankings ----------------------------------------------------------


def rank_attributes(merits: DataFrame, merit: str = "gain", count: int | None = None, threshold: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Attributes by falling merit with their rank, cut by count or threshold."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.round(merit, 9).desc(), "attr")
    out = merits.select(*by, "attr", merit, F.row_number().over(w).alias("rank"))
    if threshold is not None:
        out = out.filter(F.col(merit) >= threshold)
    return out if count is None else out.filter(F.col("rank") <= count)


def feature_selection_cv(rankings: DataFrame, merit: str = "gain") -> DataFrame:
    """Mean and population deviation of merit and rank over folds."""
    return rankings.groupBy("attr").agg(
        F.avg(merit).alias("mean_merit"), F.stddev_pop(merit).alias("sd_merit"), F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("sd_rank")
    )


def selection_counts(selected: DataFrame, folds: int) -> DataFrame:
    """Folds that select an attribute, and their share."""
    return selected.groupBy("attr").agg(F.count(F.lit(1)).alias("folds"), (F.count(F.lit(1)) / F.lit(folds)).alias("share"))
