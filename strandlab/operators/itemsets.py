"""Frequent item sets and association rules over labelled rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.series import explode_range
from strandlab.session import cut


def item_list(attrs: Sequence[str]) -> Column:
    """The items ``attr=value`` of a row; a missing value is not an item."""
    return F.array_compact(F.array(*[F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{a}="), F.col(a).cast("string"))) for a in attrs]))


def support_count(share: float, n: int) -> int:
    return int(share * n + 0.5)


def frequent_itemsets(
    df: DataFrame, attrs: Sequence[str], lower: float, upper: float = 1.0, max_size: int | None = None
) -> DataFrame:
    """Item sets with ``lower <= support <= upper``: ``(itemset, size, n)``, items in order.

    Items are counted first; only those within both bounds take part, since a set is never more frequent than its
    items.  Their sets come from conditional pattern trees: each task builds prefix trees of its rows for groups of items, equal
    prefixes are one path with a count, the trees of a group are merged and mined together.  No candidate
    with an infrequent subset is ever made.  ``max_size`` leaves out larger sets.
    """
    total = df.count()
    lo, hi = max(1, support_count(lower, total)), support_count(upper, total)
    single = df.select(F.explode(item_list(attrs)).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(lo, hi))
    known = cut(single.select(F.array("i").alias("itemset"), F.lit(1).alias("size"), "n"))
    if max_size == 1 or not known.take(1):
        return known
    kept = cut(known.agg(F.collect_set(F.col("itemset")[0]).alias("_kept")))  # at most 1 / lower items an attribute
    rows = df.select(item_list(attrs).alias("items")).join(F.broadcast(kept.limit(1))).select(F.array_intersect("items", "_kept").alias("items")).filter(F.size("items") > 1)
    paired = cut(rows)
    n = paired.count()
    if not n:
        return known
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (lo - 0.5) / n)).fit(paired).freqItemsets
    more = found.filter((F.size("items") > 1) & (F.size("items") <= (max_size or len(attrs))))
    return known.unionByName(cut(more.select(F.array_sort("items").alias("itemset"), F.size("items").alias("size"), F.col("freq").alias("n"))))


def itemset_contains(rows: DataFrame, row_id: str, attrs: Sequence[str], itemsets: DataFrame) -> DataFrame:
    """``(row_id, itemset)`` where the row has all items; null never matches.

    Equi-join on the first item of a set only (each set once), then a containment
    test on the row's own short item list.
    """
    long = rows.select(F.col(row_id).alias("row_id"), item_list(attrs).alias("items")).withColumn("first", F.explode("items"))
    sets = itemsets.select("itemset", F.element_at("itemset", 1).alias("first"))
    hit = long.join(sets, "first").filter(F.size(F.array_except("itemset", "items")) == 0)
    return hit.select("row_id", "itemset")


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square statistic of the 2 x 2 table [[a, b], [c, d]]; 0 with an empty margin."""
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, n * (a * d - b * c) * (a * d - b * c) / margins).otherwise(F.lit(0.0))


def chi_critical(significance: float) -> float:
    """The statistic with one degree of freedom whose tail probability is ``significance``."""
    low, high = 0.0, 1.0
    while math.erfc(math.sqrt(high / 2)) > significance:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > significance else (low, middle)
    return high


def association_rules(
    itemsets: DataFrame, total: int, metric: str = "confidence", minimum: float = 0.9, significance: float | None = None
) -> DataFrame:
    """All premise => consequence splits with their measures.

    Conviction keeps the ``+ 1`` in its denominator.  With ``significance`` the
    chi-square tail probability must not exceed it.  A set of k items (at most 62) has 2**k - 2 splits, which are made in
    steps, so no row holds them all.
    """
    splits = F.pow(F.lit(2.0), F.size("itemset")).cast("long") - 2
    split = explode_range(itemsets.filter(F.col("size") >= 2).select("itemset", "n"), splits, "_split").withColumn("mask", F.col("_split") + 1)

    def picked(bit: int) -> Column:
        return F.filter("itemset", lambda x, i: F.call_function("shiftright", F.col("mask"), i) % 2 == bit)

    rules = split.select("n", picked(1).alias("premise"), picked(0).alias("consequence"))
    base = itemsets.select("itemset", F.col("n").alias("c"))
    rules = rules.join(base.select(F.col("itemset").alias("premise"), F.col("c").alias("n_premise")), "premise")
    rules = rules.join(base.select(F.col("itemset").alias("consequence"), F.col("c").alias("n_consequence")), "consequence")
    both, p, q, n = (F.col(x).cast("double") for x in ("n", "n_premise", "n_consequence", "_t"))
    rules = rules.withColumn("_t", F.lit(float(total)))
    rules = rules.withColumns(
        {
            "confidence": both / p,
            "lift": (both / p) / (q / n),
            "leverage": both / n - (p / n) * (q / n),
            "conviction": p * (n - q) * n / (p - both + 1),
            "chi_square": chi_square(both, p - both, q - both, n - p - q + both),
        }
    ).drop("_t")
    rules = rules.filter(F.col(metric) >= minimum)
    if significance is not None:
        rules = rules.filter(F.col("chi_square") >= chi_critical(significance))
    return rules


def top_rules(
    df: DataFrame,
    attrs: Sequence[str],
    n_rules: int = 10,
    delta: float = 0.05,
    lower: float = 0.1,
    upper: float = 1.0,
    metric: str = "confidence",
    minimum: float = 0.9,
    max_size: int | None = None,
) -> DataFrame:
    """Lower the support by ``delta`` until ``n_rules`` rules hold; best rules first.

    The sets are mined once at the lower bound: a cycle with a higher support is a
    filter on the rule table, since its sub-sets have at least the same count.
    """
    total = df.count()
    rules = cut(association_rules(frequent_itemsets(df, attrs, lower, upper, max_size), total, metric, minimum))
    cycles, share = [], upper
    while True:
        share = max(share - delta, lower)
        cycles.append(support_count(share, total))
        if share <= lower + 1e-12:
            break
    held = rules.agg(*[F.count_if(F.col("n") >= c).alias(f"c{i}") for i, c in enumerate(cycles)]).first()
    chosen = next((c for i, c in enumerate(cycles) if held[i] >= n_rules), cycles[-1])
    best = rules.filter(F.col("n") >= chosen)
    return best.orderBy(F.round(metric, 9).desc(), F.col("n").desc(), "premise", "consequence").limit(n_rules)


