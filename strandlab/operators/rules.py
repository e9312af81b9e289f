"""Nominal trees, covering rules and rule cascades.

All of them grow on the table of distinct attribute combinations with their
weights, which one aggregate builds; the rows themselves are never revisited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import best_label
from strandlab.operators.counts import contingency, info_gain
from strandlab.session import cut

MISSING = "?"


def distinct_cells(df: DataFrame, attrs: Sequence[str], label: str = "label") -> DataFrame:
    """Weight of every (attribute combination, class)."""
    src = df.filter(F.col(label).isNotNull()).select(
        *[F.coalesce(F.col(a).cast("string"), F.lit(MISSING)).alias(a) for a in attrs], F.col(label).alias("label")
    )
    return src.groupBy(*attrs, "label").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _step(attr: Column, value: Column) -> Column:
    return F.concat(attr, F.lit("="), value)


def id3_tree(df: DataFrame, attrs: Sequence[str], label: str = "label", max_depth: int | None = None) -> DataFrame:
    """Level-wise information-gain tree.

    One row per node: ``node`` (path of ``attr=value`` joined by ``/``), ``depth``,
    ``attr`` (split attribute, null at a leaf), ``predicted``, ``n`` and
    ``gain``.  Each level handles all of its nodes in one aggregate.
    """
    depth_limit = len(attrs) if max_depth is None else max_depth
    live = cut(distinct_cells(df, attrs, label).withColumn("node", F.lit("")))
    levels: list[DataFrame] = []
    for depth in range(depth_limit + 1):
        classes = live.groupBy("node", "label").agg(F.sum("w").alias("w"))
        leaf = classes.groupBy("node").agg(
            best_label(F.col("w"), F.col("label")).alias("predicted"), F.sum("w").alias("n")
        )
        if depth < depth_limit:
            gains = info_gain(contingency(live, attrs, "label", ["node"], "w"), ["node"])
            best = gains.groupBy("node").agg(
                F.min(F.struct((-F.round("gain", 9)).alias("s"), F.col("attr"), F.col("gain"))).alias("b")
            )
            best = best.select("node", F.when(F.col("b.gain") > 1e-6, F.col("b.attr")).alias("attr"), F.col("b.gain").alias("gain"))
            level = leaf.join(best, "node", "left")
        else:
            level = leaf.withColumn("attr", F.lit(None).cast("string")).withColumn("gain", F.lit(None).cast("double"))
        level = cut(level.select("node", F.lit(depth).alias("depth"), "attr", "predicted", "n", "gain"))
        levels.append(level)
        splits = level.filter(F.col("attr").isNotNull()).select("node", "attr")
        if depth == depth_limit or not splits.take(1):
            break
        value = F.coalesce(*[F.when(F.col("attr") == a, F.col(a)) for a in attrs])
        path = _step(F.col("attr"), value)
        live = live.join(splits, "node").withColumn(
            "node", F.when(F.col("node") == "", path).otherwise(F.concat_ws("/", "node", path))
        )
        live = cut(live.drop("attr"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def tree_score(df: DataFrame, model: DataFrame, attrs: Sequence[str], depth: int | None = None) -> DataFrame:
    """Follow the tree; a value without a branch gives a null prediction."""
    nodes = model.select(
        F.col("node").alias("_n"), F.col("attr").alias("_a"), F.col("predicted").alias("_p")
    )
    out = df.withColumns({"_node": F.lit(""), "predicted": F.lit(None).cast("string")})
    for _ in range((len(attrs) if depth is None else depth) + 1):
        out = out.join(nodes, F.col("_node") == F.col("_n"), "left")
        value = F.coalesce(*[F.when(F.col("_a") == a, F.coalesce(F.col(a).cast("string"), F.lit(MISSING))) for a in attrs])
        path = _step(F.col("_a"), value)
        out = out.withColumn("predicted", F.when(F.col("_n").isNotNull() & F.col("_a").isNull(), F.col("_p")).otherwise(F.col("predicted")))
        out = out.withColumn(
            "_node",
            F.when(F.col("_a").isNull(), F.lit(None)).when(F.col("_node") == "", path).otherwise(F.concat_ws("/", "_node", path)),
        ).drop("_n", "_a", "_p")
    return out.drop("_node")


# -- conjunctive rules ---------------------------------------------------------


def rule_condition(conditions: dict[str, str]) -> Column:
    """Conjunction that is false, never null, when an attribute is missing."""
    out = F.lit(True)
    for a, v in conditions.items():
        out = out & F.col(a).cast("string").eqNullSafe(F.lit(v))
    return out


def covered_by(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    return df.filter(rule_condition(conditions))


def not_covered_by(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    return df.filter(~rule_condition(conditions))


def _best_tests(live: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Best next test of every unfinished target: precision, then coverage."""
    stacked = live.select(
        "target", "label", "w", "used", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("attr"), F.col(a).alias("value")) for i, a in enumerate(attrs)])).alias("z")
    ).filter(~F.array_contains("used", F.col("z.attr")))
    tests = stacked.groupBy("target", "z.pos", "z.attr", "z.value").agg(
        F.sum("w").alias("covers"), F.sum(F.when(F.col("label") == F.col("target"), F.col("w")).otherwise(0.0)).alias("correct")
    )
    order = F.struct(
        (-F.round(F.col("correct") / F.col("covers"), 12)).alias("a"), (-F.col("correct")).alias("b"), "pos", "value", "attr", "covers", "correct"
    )
    return tests.groupBy("target").agg(F.min(order).alias("t")).select(
        "target", F.col("t.attr").alias("attr"), F.col("t.value").alias("value"), F.col("t.covers").alias("covers"), F.col("t.correct").alias("correct")
    )


def covering_rules(df: DataFrame, attrs: Sequence[str], label: str = "label", max_rules: int | None = None) -> DataFrame:
    """Separate-and-conquer rules, all classes at once.

    Returns ``(target, rule, test, covers, correct)`` where ``test`` is the sorted
    list of ``attr=value``.  Each round adds one rule per class that still has
    uncovered examples; only the round's small tables are written out.
    """
    cells = distinct_cells(df, attrs, label)
    targets = cells.select(F.col("label").alias("target")).distinct()
    left = cut(cells.join(targets))
    rounds: list[DataFrame] = []
    number = 0
    while max_rules is None or number < max_rules:
        open_targets = left.filter(F.col("label") == F.col("target")).select("target").distinct()
        if not open_targets.take(1):
            break
        live = left.join(open_targets, "target", "left_semi").withColumns(
            {"used": F.array().cast("array<string>"), "test": F.array().cast("array<string>"), "covers": F.lit(0.0), "correct": F.lit(-1.0)}
        )
        for _ in attrs:
            todo = live.filter(F.col("covers") != F.col("correct"))
            best = _best_tests(todo, attrs).select(
                "target", F.col("attr").alias("_a"), F.col("value").alias("_v"), F.col("covers").alias("_c"), F.col("correct").alias("_k")
            )
            joined = live.join(best, "target", "left")
            value = F.coalesce(*[F.when(F.col("_a") == a, F.col(a)) for a in attrs])
            hit = joined.filter(F.col("_a").isNull() | (value == F.col("_v")))
            grow = F.col("_a").isNotNull()
            live = hit.withColumns(
                {
                    "used": F.when(grow, F.concat("used", F.array("_a"))).otherwise(F.col("used")),
                    "test": F.when(grow, F.concat("test", F.array(_step(F.col("_a"), F.col("_v"))))).otherwise(F.col("test")),
                    "covers": F.coalesce("_c", "covers"),
                    "correct": F.coalesce("_k", "correct"),
                }
            ).drop("_a", "_v", "_c", "_k")
        number += 1
        live = cut(live)
        rounds.append(live.select("target", F.lit(number).alias("rule"), F.array_sort("test").alias("test"), "covers", "correct").distinct())
        left = cut(left.join(live.select("target", "label", *attrs), ["target", "label", *attrs], "left_anti"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def covering_predict(df: DataFrame, rules: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """First rule that matches, in class and then rule order."""
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("target", "rule", "test"))).alias("_rules"))
    items = F.array(*[_step(F.lit(a), F.coalesce(F.col(a).cast("string"), F.lit(MISSING))) for a in attrs])
    out = df.withColumn("_items", items).join(listed)
    fit = F.filter("_rules", lambda r: F.size(F.array_except(r["test"], F.col("_items"))) == 0)
    return out.withColumn("predicted", F.try_element_at(F.transform(fit, lambda r: r["target"]), F.lit(1))).drop("_items", "_rules")


MAX_RULES = 20_000  # a rule list is a model, not data


def rule_cascade_score(df: DataFrame, rules: DataFrame, attrs: Sequence[str], classes: int) -> DataFrame:
    """Weighted ordered rules: ``sum += rest * p`` and ``rest *= 1 - w`` per matching rule.

    ``rules(ord, test array<attr=value>, weight, probs array)`` is a small model;
    it travels as one row and each data row folds over it, without a shuffle.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("ord", "test", "weight", "probs"))).alias("_rules"))
    items = F.array(*[_step(F.lit(a), F.coalesce(F.col(a).cast("string"), F.lit(MISSING))) for a in attrs])
    out = df.withColumn("_items", items).join(listed)
    hits = F.filter("_rules", lambda r: F.size(F.array_except(r["test"], F.col("_items"))) == 0)
    start = F.struct(F.lit(1.0).alias("rest"), F.array_repeat(F.lit(0.0), classes).alias("sum"))

    def fold(state: Column, rule: Column) -> Column:
        live = state["rest"] > 1e-6
        return F.struct(
            F.when(live, state["rest"] * (1 - rule["weight"])).otherwise(state["rest"]).alias("rest"),
            F.when(live, F.zip_with(state["sum"], rule["probs"], lambda a, p: a + state["rest"] * p)).otherwise(state["sum"]).alias("sum"),
        )

    return out.withColumn("probs", F.aggregate(hits, start, fold, lambda s: s["sum"])).drop("_items", "_rules")
