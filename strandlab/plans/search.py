"""Attribute subsets, races and parameter search."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions.exprs import let
from strandlab.functions.tails import incomplete_beta
from strandlab.operators.bayes import CLASS_ATTR, LIKELIHOOD_FLOOR
from strandlab.operators.rules import distinct_cells
from strandlab.plans.folds import assign_folds
from strandlab.plans.learners import CountLearner, NaiveBayes, class_counts, fold_training_counts, train
from strandlab.session import cut


class SubsetEvaluator(Protocol):
    """Scores attribute subsets given as ``{subset_id: [attr, ...]}`` in one job."""

    def errors(self, subsets: dict[str, Sequence[str]]) -> DataFrame: ...


def _class_logs(df: DataFrame, prior: DataFrame, model: DataFrame, attrs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per row: ``_classes``, ``_prior`` and ``_attr`` (log likelihood arrays per attribute)."""
    on = list(by)
    base = prior.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("label", F.log("prior").alias("lp")))).alias("_p"))
    out = df.join(base, on) if on else df.join(base)
    zero = F.transform("_p", lambda c: F.lit(0.0))
    rows = model.groupBy(*on, "attr", "value").agg(
        F.array_sort(F.collect_list(F.struct("label", F.log(F.greatest("p", F.lit(LIKELIHOOD_FLOOR))).alias("lp")))).alias("_m")
    )
    for i, a in enumerate(attrs):
        side = rows.filter(F.col("attr") == a).select(
            *[F.col(b).alias(f"_q{j}") for j, b in enumerate(on)], F.col("value").alias("_v"), F.transform("_m", lambda r: r["lp"]).alias(f"_l{i}")
        )
        cond = [F.col(f"_q{j}") == F.col(b) for j, b in enumerate(on)] + [F.col("_v") == F.col(a).cast("string")]
        out = out.join(side, cond, "left").drop("_v", *[f"_q{j}" for j in range(len(on))])
    logs = F.array(*[F.coalesce(f"_l{i}", zero) for i in range(len(attrs))])
    out = out.withColumn("_attr", logs).drop(*[f"_l{i}" for i in range(len(attrs))])
    return out.withColumns({"_classes": F.transform("_p", lambda c: c["label"]), "_prior": F.transform("_p", lambda c: c["lp"])}).drop("_p")


def _subset_wrong(positions: Sequence[int], label: str = "label") -> Column:
    """1.0 when the class chosen from the given attributes is not the row's class."""
    total = F.col("_prior")
    for p in positions:
        total = F.zip_with(total, F.col("_attr")[p], lambda a, b: a + b)
    rounded = F.transform(total, lambda v: F.round(v, 9))
    pick = let(rounded, lambda s: F.element_at("_classes", F.array_position(s, F.array_max(s)).cast("int")))
    return F.when(pick == F.col(label), 0.0).otherwise(1.0)


def _melt(one: DataFrame, names: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    return one.unpivot(list(by), list(names), "subset_id", value)


def fold_cells(df: DataFrame, attrs: Sequence[str], folds: int, seed: int = 0, row_id: str = "id", label: str = "label") -> DataFrame:
    """Written table of (fold, attribute combination, class) with its weight and its log likelihoods from the other folds.

    Rows are dealt, counted and scored once; every subset of the attributes is then a different sum over this table.
    """
    clean = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    cells = cut(assign_folds(clean, folds, seed, row_id).groupBy("fold", *attrs, "label").agg(F.count(F.lit(1)).cast("double").alias("w")))
    return _scored_cells(cells, cut(fold_training_counts(cells, attrs, folds, weight="w")), attrs, ["fold"])


def _scored_cells(cells: DataFrame, counts: DataFrame, attrs: Sequence[str], by: Sequence[str]) -> DataFrame:
    model = cut(NaiveBayes(attrs).fit(counts, by))
    prior = model.filter(F.col("attr") == CLASS_ATTR).select(*by, "label", F.col("p").alias("prior"))
    return cut(_class_logs(cells, prior, model.filter(F.col("attr") != CLASS_ATTR), attrs, by))


class _BayesError:
    """Weighted error of naive Bayes on each subset, over cells that hold every attribute's log likelihoods."""

    def __init__(self, cells: DataFrame, attrs: Sequence[str]) -> None:
        self.cells, self.attrs = cells, list(attrs)

    def wrong(self, subset: Sequence[str]) -> Column:
        return _subset_wrong([self.attrs.index(a) for a in subset])

    def errors(self, subsets: dict[str, Sequence[str]]) -> DataFrame:
        sums = [(F.sum(F.col("w") * self.wrong(s)) / F.sum("w")).alias(k) for k, s in subsets.items()]
        return _melt(self.cells.agg(*sums), list(subsets), "error")


class FoldError(_BayesError):
    """Cross-validated error."""

    def __init__(self, df: DataFrame, attrs: Sequence[str], folds: int = 5, seed: int = 0, row_id: str = "id", label: str = "label") -> None:
        super().__init__(fold_cells(df, attrs, folds, seed, row_id, label), attrs)


class HoldoutError(_BayesError):
    """Error on test rows of a model of the training rows."""

    def __init__(self, train: DataFrame, test: DataFrame, attrs: Sequence[str], label: str = "label") -> None:
        cells = test.withColumnRenamed(label, "label").groupBy(*attrs, "label").agg(F.count(F.lit(1)).cast("double").alias("w"))
        super().__init__(_scored_cells(cells, cut(class_counts(train, attrs, label)), attrs, []), attrs)


class Inconsistency:
    """Share of rows that are not of the majority class of their combination of the subset's values; a missing value is a value."""

    def __init__(self, df: DataFrame, attrs: Sequence[str], label: str = "label") -> None:
        self.cells, self.attrs = cut(distinct_cells(df, attrs, label)), list(attrs)

    def errors(self, subsets: dict[str, Sequence[str]]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("subset_id"), F.array(*[F.col(a) if a in s else F.lit("") for a in self.attrs]).alias("values")) for k, s in subsets.items()])
        rows = self.cells.select("label", "w", F.explode(each).alias("z")).groupBy("z", "label").agg(F.sum("w").alias("w"))
        best = rows.groupBy("z").agg(F.max("w").alias("best"), F.sum("w").alias("w"))
        return best.groupBy(F.col("z.subset_id").alias("subset_id")).agg((1.0 - F.sum("best") / F.sum("w")).alias("error"))


def best_first(evaluator: SubsetEvaluator, attrs: Sequence[str], start: Sequence[str] = (), backward: bool = False, stale: int = 5) -> DataFrame:
    """Best-first search with backtracking: ``(subset_id, attrs, error, round, best)`` of every subset scored.

    Scored subsets are a table that each round adds to.  A round expands the best subset that has not been expanded,
    wherever it lies, and scores those of its neighbours (one attribute more, or one less) that the table does not have, in
    one job.  The search ends after ``stale`` expansions in a row without a better subset, or with nothing to expand.
    Equal errors go to fewer attributes, then to the smaller name.
    """

    def score(sets: list[frozenset], number: int) -> DataFrame:
        named = {_key(s): sorted(s) for s in sets}
        lists = F.create_map(*[x for k, s in named.items() for x in (F.lit(k), F.array(*map(F.lit, s)).cast("array<string>"))])
        return cut(evaluator.errors(named).select("subset_id", lists[F.col("subset_id")].alias("attrs"), "error", F.lit(number).alias("round")))

    order = [F.round("error", 9), F.size("attrs"), F.col("subset_id")]
    scored, number, misses = score([frozenset(start)], 0), 0, 0
    seen, expanded = {frozenset(start)}, set()
    best = scored.first()
    while misses < stale:
        top = scored.filter(~F.col("subset_id").isin(list(expanded))).orderBy(*order).first()
        if top is None:
            break
        expanded.add(top["subset_id"])
        now = frozenset(top["attrs"])
        fresh = [s for s in ((now - {a}) if backward else (now | {a}) for a in sorted(attrs)) if s not in seen]
        better = False
        if fresh:
            number += 1
            seen |= set(fresh)
            scored = scored.unionByName(score(fresh, number))
            found = scored.orderBy(*order).first()
            better = round(found["error"], 9) < round(best["error"], 9)
            best = found
        misses = 0 if better else misses + 1
    return scored.withColumn("best", F.col("subset_id") == best["subset_id"])


def subset_eval_holdout(subsets: dict[str, Sequence[str]], train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Test error of naive Bayes on each attribute subset: ``(subset_id, error)``.

    The union of the attributes is fitted and joined once, on the distinct combinations of the test rows.  A subset is
    then only a different sum per combination, so all candidates are aggregated in one pass.
    """
    return HoldoutError(train, test, sorted({a for s in subsets.values() for a in s}), label).errors(subsets)


def subset_eval_numeric(subsets: dict[str, Sequence[str]], train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Mean absolute error of cell means on each subset: ``(subset_id, error)``.

    A row is predicted by the training mean of its attribute combination, or by the overall mean for an unseen one.
    All subsets are read off one table of training sums and one of test rows, both by whole combination.
    """
    attrs = sorted({a for s in subsets.values() for a in s})
    sums = cut(train.groupBy(*attrs).agg(F.sum(target).alias("s"), F.count(target).cast("double").alias("n")))
    overall = sums.agg((F.sum("s") / F.sum("n")).alias("_all"))

    def spread(df: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("subset_id"), F.array(*[F.col(a).cast("string") if a in s else F.lit("") for a in attrs]).alias("values")) for k, s in subsets.items()])
        return df.withColumn("_z", F.explode(each))

    means = cut(spread(sums).groupBy("_z").agg((F.sum("s") / F.sum("n")).alias("_m")))
    rows = spread(test.filter(F.col(target).isNotNull()).select(*attrs, F.col(target).alias("_y"))).join(F.broadcast(overall.limit(1)))
    met = means.withColumnRenamed("_z", "_t")
    whole = F.forall(F.col("_z.values"), lambda v: v.isNotNull())  # a missing value is unseen
    out = rows.join(met, (F.col("_z") == F.col("_t")) & whole, "left")
    return out.groupBy(F.col("_z.subset_id").alias("subset_id")).agg(F.avg(F.abs(F.col("_y") - F.coalesce("_m", "_all"))).alias("error"))


def subset_eval_cv(subsets: dict[str, Sequence[str]], df: DataFrame, folds: int = 5, repeats: int = 5, threshold: float = 0.01, row_id: str = "id", label: str = "label") -> DataFrame:
    """Repeated cross-validation per subset until sd / mean <= threshold: ``(subset_id, repeats, error)``.

    One job per repetition scores every subset that still needs one; the stop rule
    sees one number per subset.
    """
    attrs = sorted({a for s in subsets.values() for a in s})
    seen: dict[str, list[float]] = {k: [] for k in subsets}
    live = list(subsets)
    for rep in range(repeats):
        for r in FoldError(df, attrs, folds, rep, row_id, label).errors({k: subsets[k] for k in live}).collect():
            seen[r["subset_id"]].append(float(r["error"]))
        live = [k for k in live if len(seen[k]) < 2 or (np.mean(seen[k]) > 0 and np.std(seen[k], ddof=1) / np.mean(seen[k]) > threshold)]
        if not live:
            break
    rows = [(k, len(v), float(np.mean(v))) for k, v in seen.items()]
    return df.sparkSession.createDataFrame(rows, "subset_id string, repeats int, error double")


# -- races -----------------------------------------------------------------------


def race_table(subsets: dict[str, Sequence[str]], scored: FoldError) -> DataFrame:
    """Weights ``(fold, i, j, w)`` of rows that subsets i and j (i < j, or i = j) both get wrong; i = -1 counts all rows.

    Errors are 0/1, so these sums give all paired statistics.  A cell meets only the subsets that get it wrong.
    """
    wrong = F.filter(F.array(*[F.when(scored.wrong(s) == 1.0, F.lit(i)) for i, s in enumerate(subsets.values())]), lambda i: i.isNotNull())
    cells = scored.cells.select("fold", "w", wrong.alias("e"))
    pairs = cells.select("fold", "w", F.explode("e").alias("i"), "e").select("fold", "w", "i", F.explode(F.filter("e", lambda j: j >= F.col("i"))).alias("j"))
    every = cells.select("fold", "w", F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    return pairs.unionByName(every).groupBy("fold", "i", "j").agg(F.sum("w").alias("w"))


def run_race(subsets: dict[str, Sequence[str]], scored: FoldError, delta: float = 0.001, alpha: float = 0.001, min_rows: int = 20) -> tuple[str, float, list[str]]:
    """Compare subsets on shared test rows, batch by batch: (winner, error, survivors).

    After each fold a subset leaves when it is significantly worse than another or
    when it cannot be told apart by more than ``delta``; the earlier one stays.
    """
    names = list(subsets)
    live = list(range(len(names)))
    n, s, c = 0.0, np.zeros(len(names)), np.zeros((len(names), len(names)))
    found = race_table(subsets, scored).collect()  # one number per fold and pair of competing subsets
    for fold in sorted({r["fold"] for r in found}):
        for r in found:
            if r["fold"] == fold and r["i"] < 0:
                n += r["w"]
            elif r["fold"] == fold and r["i"] == r["j"]:
                s[r["i"]] += r["w"]
            elif r["fold"] == fold:
                c[r["i"], r["j"]] += r["w"]
        if n < min_rows:
            continue
        for i in list(live):
            for j in list(live):
                if not (i < j and i in live and j in live):
                    continue
                mean = (s[i] - s[j]) / n
                var = max(((s[i] + s[j] - 2 * c[i, j]) - n * mean * mean) / max(n - 1, 1), 0.0)
                se = np.sqrt(var / n)

                def p_of(shift: float) -> float:
                    if se == 0:
                        return 0.0 if shift else 1.0
                    t = shift / se
                    return float(incomplete_beta((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t)))

                if p_of(mean) < alpha:
                    live.remove(i if mean > 0 else j)
                elif abs(mean) < delta and (se == 0 or p_of(delta - abs(mean)) < alpha):
                    live.remove(j)
        if len(live) == 1:
            break
    best = min(live, key=lambda i: (round(s[i] / n, 9), i))
    return names[best], float(s[best] / n), [names[i] for i in live]


def _key(attrs: Sequence[str]) -> str:
    return "+".join(sorted(attrs)) or "(none)"


def hill_race(df: DataFrame, attrs: Sequence[str], backward: bool = False, folds: int = 10, row_id: str = "id", label: str = "label") -> DataFrame:
    """Forward or backward race: one step per row ``(step, subset_id, error, survivors)``."""
    scored = FoldError(df, attrs, folds, 0, row_id, label)  # fitted once, for all steps
    base = set(attrs) if backward else set()
    steps, error = [], None
    while True:
        moves = sorted(base) if backward else sorted(set(attrs) - base)
        if not moves:
            break
        sets = {_key(base): sorted(base)} | {_key(m): sorted(m) for m in ((base - {a}) if backward else (base | {a}) for a in moves)}
        winner, now, left = run_race(sets, scored)
        if winner == _key(base) or (error is not None and now >= error):
            if error is None:
                steps.append((len(steps), winner, now, len(left)))
            break
        base, error = set(sets[winner]), now
        steps.append((len(steps), winner, now, len(left)))
    return df.sparkSession.createDataFrame(steps, "step int, subset_id string, error double, survivors int")


def rank_race(df: DataFrame, ranking: Sequence[str], folds: int = 10, row_id: str = "id", label: str = "label") -> DataFrame:
    """Nested prefixes of a ranking raced once."""
    sets = {f"top{i}": list(ranking[:i]) for i in range(len(ranking) + 1)}
    winner, error, left = run_race(sets, FoldError(df, sorted(ranking), folds, 0, row_id, label))
    return df.sparkSession.createDataFrame([(winner, "+".join(sets[winner]), error, len(left))], "prefix string, subset_id string, error double, survivors int")


def schemata_race(df: DataFrame, attrs: Sequence[str], trials: int = 16, folds: int = 5, alpha: float = 0.05, rounds: int | None = None, seed: int = 1, row_id: str = "id", label: str = "label") -> DataFrame:
    """Decide attributes one after another by random subsets: ``(attr, keep, p, round)``.

    Each round scores ``trials`` random subsets in one job.  The attribute whose
    errors with and without it differ most clearly is fixed, with all that differ
    significantly, until none is left; with ``rounds`` the last round fixes the rest.
    """
    fixed: dict[str, bool] = {}
    rows = []
    scored = FoldError(df, sorted(attrs), folds, 0, row_id, label)  # fitted once, for all rounds
    number = 0
    while len(fixed) < len(attrs):
        number += 1
        free = [a for a in attrs if a not in fixed]
        rng = np.random.default_rng([seed, number])
        # half of the subsets hold an attribute, so that both sides of every test have rows
        bits = np.argsort(rng.random((trials, len(free))), axis=0) < trials // 2
        subsets = {f"t{i}": [a for a in attrs if fixed.get(a) or (a in free and bits[i, free.index(a)])] for i in range(trials)}
        row = {r["subset_id"]: r["error"] for r in scored.errors(subsets).collect()}
        errors = np.array([row[k] for k in subsets])
        tests = []
        for i, a in enumerate(free):
            x, y = errors[bits[:, i]], errors[~bits[:, i]]
            if len(x) < 2 or len(y) < 2:
                continue
            dof = len(x) + len(y) - 2
            pooled = ((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / dof
            gap = x.mean() - y.mean()
            if pooled <= 0:
                p = 0.0 if gap else 1.0
            else:
                t = gap / np.sqrt(pooled * (1 / len(x) + 1 / len(y)))
                p = float(incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)))
            tests.append((p, a, gap))
        for p, a, gap in sorted(tests):
            if p <= alpha or (rounds is not None and number >= rounds) or a == sorted(tests)[0][1]:
                fixed[a] = bool(gap < 0)
                rows.append((a, bool(gap < 0), float(p), number))
    return df.sparkSession.createDataFrame(rows, "attr string, keep boolean, p double, `round` int")


# -- parameters ------------------------------------------------------------------


def grid_search_cv(results: DataFrame, params: Sequence[str], metric: str = "error") -> DataFrame:
    """Mean cross-validated error per parameter combination and the best one."""
    per = results.groupBy(*params).agg(F.avg(metric).alias("error"), F.count(F.lit(1)).alias("folds"))
    best = per.agg(F.min(F.struct(F.round("error", 9).alias("e"), *params)).alias("_b"))
    out = per.join(F.broadcast(best.limit(1)))
    hit = F.lit(True)
    for p in params:
        hit = hit & (F.col(p) == F.col("_b")[p])
    return out.withColumn("best", hit).drop("_b")


def resolve_bound(bound: str | float, attributes: int, training_rows: int) -> float:
    """Upper limit of a grid: a number, the attribute count with the class ("A") or the rows of a training fold ("I")."""
    return {"A": float(attributes), "I": float(training_rows)}[bound] if isinstance(bound, str) else float(bound)


@dataclass(frozen=True)
class Parameter:
    """``steps`` values from ``lower`` to ``upper``, equally spaced; ``upper`` may be "A" or "I" (see ``resolve_bound``)."""

    name: str
    lower: float
    upper: float | str
    steps: int
    whole: bool = False

    def values(self, attributes: int, training_rows: int) -> list[float]:
        upper = resolve_bound(self.upper, attributes, training_rows)
        if upper < self.lower or self.steps < 1:
            raise ValueError(f"{self.name}: upper bound {upper} is below {self.lower}, or there are no steps")
        step = (upper - self.lower) / max(1, self.steps - 1)
        found = [self.lower + i * step for i in range(self.steps if step else 1)]
        return list(dict.fromkeys(float(round(v)) for v in found)) if self.whole else found


def parameter_search(df: DataFrame, learner: CountLearner, params: Sequence[Parameter], folds: int = 10, seed: int = 0, row_id: str = "id", label: str = "label") -> DataFrame:
    """Cross-validated error of ``learner`` at every point of the grid: ``(point, <params>, n, error, best)``.

    The learner names the parameters as columns of ``by``.  Rows are read once, as weights of (fold, attribute
    combination, class); the training counts of all folds follow from these weights, meet the grid's points and are
    fitted together, and every combination is scored once per point by the model that has not seen its fold.  The first of the points
    with the least error is the best.
    """
    attrs = list(learner.attrs)
    clean = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    cells = cut(assign_folds(clean, folds, seed, row_id).groupBy("fold", *attrs, "label").agg(F.count(F.lit(1)).cast("double").alias("w")))
    sizes = {r["fold"]: r["n"] for r in cells.groupBy("fold").agg(F.sum("w").alias("n")).collect()}  # one row a fold
    if len(sizes) < folds:
        raise ValueError(f"{int(sum(sizes.values()))} rows with a class do not fill {folds} folds")
    values = [p.values(len(attrs) + 1, int(sum(sizes.values()) - sizes[0])) for p in params]
    points = [F.struct(F.lit(i).alias("point"), *[F.lit(float(v)).alias(p.name) for p, v in zip(params, point)]) for i, point in enumerate(itertools.product(*values))]
    names = [p.name for p in params]

    def at_points(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_g", F.explode(F.array(*points))).select(*rows.columns, "_g.*")

    model = cut(learner.fit(at_points(cut(fold_training_counts(cells, attrs, folds, weight="w"))), ["fold", "point", *names]))
    scored = learner.score(at_points(cells), model, ["fold", "point"])
    wrong = F.when(F.col("predicted") == F.col("label"), 0.0).otherwise(F.col("w"))
    errors = cut(scored.groupBy("point", *names).agg(F.sum("w").alias("n"), (F.sum(wrong) / F.sum("w")).alias("error")))
    best = errors.agg(F.min(F.struct(F.round("error", 9).alias("e"), "point"))["point"].alias("_best"))
    return errors.join(F.broadcast(best.limit(1))).withColumn("best", F.col("point") == F.col("_best")).drop("_best")


def fit_best(df: DataFrame, make: Callable[..., CountLearner], searched: DataFrame, params: Sequence[Parameter], label: str = "label") -> tuple[CountLearner, DataFrame]:
    """The learner with the best point's parameters, and its model of all rows."""
    best = searched.filter("best").first()
    learner = make(**{p.name: best[p.name] for p in params})
    return learner, train(df, learner, label)


def doubling_search(
    evaluate: Callable[[float], float],
    start: float,
    attempts: int = 3,
    limit: int | None = None,
    together: Callable[[list[float]], list[float]] | None = None,
) -> tuple[float, float, list[tuple[float, float]]]:
    """Double, then halve a parameter until ``attempts`` values in a row do not improve; ``limit`` bounds all values tried.

    ``together`` gives the errors of several values at once.  A direction still tries as many values as may be missed, whatever their
    errors are, so these are asked for at one time, without ``limit`` those of both directions; the values tried are the same.
    """
    known: dict[float, float] = {}

    def ask(values: list[float]) -> None:
        new = [v for v in dict.fromkeys(values) if v not in known]
        known.update(zip(new, together(new) if together else [evaluate(v) for v in new]))

    def walk(factor: float, most: int | None) -> tuple[list[float], list[float], tuple[float, float]]:
        """Values tried from known errors, values needed next, and the best of those tried."""
        tried, value, top, miss = [], start, (known[start], start), 0
        while miss < attempts and (most is None or len(tried) < most):
            value *= factor
            if value not in known:
                ahead = [value * factor**i for i in range(attempts - miss)]
                return tried, ahead if most is None else ahead[: most - len(tried)], top
            tried.append(value)
            top, miss = ((known[value], value), 0) if known[value] < top[0] else (top, miss + 1)
        return tried, [], top

    every = [start] + [start * f**i for f in (2.0, 0.5) for i in range(1, attempts + 1)]
    ask(every if together and limit is None else [start])
    trace, best, left = [(start, known[start])], [], None if limit is None else limit - 1
    for factor in (2.0, 0.5):
        while (step := walk(factor, left))[1]:
            ask(step[1] + (walk(0.5, None)[1] if together and limit is None else []))
        trace += [(v, known[v]) for v in step[0]]
        best.append(step[2])
        left = None if left is None else left - len(step[0])
    error, value = best[1] if best[1][0] < best[0][0] else best[0]
    return value, error, trace
