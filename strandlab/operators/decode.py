"""Multi-class decisions from binary scores and a code matrix.

``code(clf, class, bit)`` is small (classifiers x classes).  Scores of a row are
gathered once into an array; every decoder is then an array expression, so the
long table is shuffled once and never multiplied by the number of classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_CODE_CELLS = 1_000_000


def code_one_vs_rest(domain: DataFrame) -> DataFrame:
    """``domain(pos, label)`` to one row per class against the rest (two classes: one row)."""
    n = domain.count()
    a, b = domain.select(F.col("pos").alias("clf")), domain.select(F.col("pos").alias("p"), F.col("label").alias("class"))
    if n == 2:
        return b.select(F.lit(0).alias("clf"), "class", F.when(F.col("p") == 1, 1).otherwise(-1).alias("bit"))
    return a.join(b).select("clf", "class", F.when(F.col("clf") == F.col("p"), 1).otherwise(-1).alias("bit"))


def code_all_pairs(domain: DataFrame) -> DataFrame:
    """One classifier per pair: the first class is -1, the second +1, others 0."""
    n = domain.count()
    a, b = domain.select(F.col("pos").alias("i")), domain.select(F.col("pos").alias("j"))
    clf = F.col("i") * n - F.expr("i * (i + 1) div 2") + F.col("j") - F.col("i") - 1
    pairs = a.join(b, F.col("i") < F.col("j")).withColumn("clf", clf.cast("int"))
    bit = F.when(F.col("pos") == F.col("i"), -1).when(F.col("pos") == F.col("j"), 1).otherwise(0)
    return pairs.join(domain).select("clf", F.col("label").alias("class"), bit.alias("bit"))


def code_complete(domain: DataFrame) -> DataFrame:
    """All ``2**(n-1) - 1`` two-way splits; the first class is always +1."""
    n = domain.count()
    if n * 2 ** (n - 1) > MAX_CODE_CELLS:
        raise ValueError("too many classes for a complete code")
    clfs = domain.sparkSession.range(2 ** (n - 1) - 1).select(F.col("id").cast("int").alias("clf"))
    # the side of a class in a split is its binary digit in the split's number
    digit = F.expr(f"shiftright(clf, {n - 1} - CAST(pos AS INT)) & 1")
    bit = F.when(F.col("pos") == 0, 1).otherwise(2 * digit - 1)
    return clfs.join(domain).select("clf", F.col("label").alias("class"), bit.alias("bit"))


def code_split(domain: DataFrame, a: int, b: int) -> DataFrame:
    """``a`` classes (+1) against ``b`` classes (-1); mirrored splits once if a = b."""
    n = domain.count()
    if 4**n > MAX_CODE_CELLS * 16:
        raise ValueError("too many classes for split codes")
    masks = domain.sparkSession.range(1, 2**n).select(
        F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(F.col("id") / F.pow(F.lit(2), i)) % 2 == 1).alias("s")
    )
    used = masks.filter(F.size("s") == a + b).select(F.col("s").alias("used"))
    plus = masks.filter(F.size("s") == a).select(F.col("s").alias("plus"))
    pairs = used.join(plus, F.size(F.array_except("plus", "used")) == 0)
    if a == b:
        pairs = pairs.filter(F.element_at("used", 1) == F.element_at("plus", 1))
    w = Window.partitionBy(F.lit(0)).orderBy("used", "plus")
    numbered = pairs.withColumn("clf", F.row_number().over(w) - 1)
    bit = F.when(F.array_contains("plus", F.col("pos")), 1).when(F.array_contains("used", F.col("pos")), -1).otherwise(0)
    return numbered.join(domain).select("clf", F.col("label").alias("class"), bit.alias("bit"))


def code_row(code: DataFrame) -> DataFrame:
    """The code as one row: classifiers in order and a bit array per class."""
    per_class = code.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("clf", "bit"))).alias("b"))
    return per_class.agg(
        F.array_sort(F.collect_list(F.struct("class", F.transform("b", lambda z: z["bit"]).alias("bits")))).alias("_code"),
        F.first(F.transform("b", lambda z: z["clf"])).alias("_clfs"),
    )


def gather(scores: DataFrame, code: DataFrame, value: str = "score") -> DataFrame:
    """One row per ``row_id`` with ``_s``, the scores in classifier order."""
    rows = scores.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("clf", value))).alias("_m"))
    out = rows.join(F.broadcast(code_row(code).limit(1)))
    return out.withColumn("_s", F.transform("_clfs", lambda c: F.try_element_at("_m", c))).drop("_m")


def _decode(scores: DataFrame, code: DataFrame, cost: Callable[[Column, Column], Column], weights: DataFrame | None, normalise: bool = False) -> DataFrame:
    """Sum ``cost(bit, score)`` over classifiers for every (row, class)."""
    g = gather(scores, code)
    if weights is not None:
        w = weights.agg(F.map_from_entries(F.collect_list(F.struct("clf", "weight"))).alias("_wm"))
        g = g.join(F.broadcast(w.limit(1))).withColumn("_w", F.transform("_clfs", lambda c: F.coalesce(F.try_element_at("_wm", c), F.lit(0.0))))
        if normalise:
            g = g.withColumn("_wt", F.aggregate("_w", F.lit(0.0), lambda s, v: s + v)).withColumn("_w", F.transform("_w", lambda v: v / F.col("_wt")))
    else:
        g = g.withColumn("_w", F.transform("_clfs", lambda c: F.lit(1.0)))
    g = g.withColumn("_sw", F.arrays_zip("_s", "_w"))

    def total(c: Column) -> Column:
        terms = F.zip_with(c["bits"], F.col("_sw"), lambda b, sw: sw["_w"] * F.coalesce(cost(b, sw["_s"]), F.lit(0.0)))
        return F.struct(c["class"].alias("class"), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v).alias("value"))

    return g.select("row_id", F.explode(F.transform("_code", total)).alias("z")).select("row_id", "z.class", "z.value")


def _sign(score: Column, threshold: float) -> Column:
    return F.when(score <= threshold, -1).otherwise(1)


def decode_hamming(scores: DataFrame, code: DataFrame, threshold: float = 0.0, weights: DataFrame | None = None) -> DataFrame:
    """``sum((1 - bit * sign) / 2)``; weights are normalised to one."""
    return _decode(scores, code, lambda b, s: (1 - b * _sign(s, threshold)) / 2.0, weights, normalise=True)


def decode_wins(scores: DataFrame, code: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Number of classifiers whose sign equals the class bit."""
    out = _decode(scores, code, lambda b, s: F.when(b == _sign(s, threshold), 1.0).otherwise(0.0), None)
    return out.withColumn("value", F.col("value").cast("long"))


def decode_prob_sum(scores: DataFrame, code: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``p`` or ``1 - p``; a zero bit counts 0.5, or nothing in the weighted form."""
    zero = 0.5 if weights is None else 0.0
    return _decode(scores, code, lambda b, s: F.when(b == 1, s).when(b == -1, 1 - s).otherwise(F.lit(zero)), weights)


def decode_score_sum(scores: DataFrame, code: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    return _decode(scores, code, lambda b, s: b * s, weights)


# losses of the margin z = bit * score
LOSSES: dict[str, Callable[[Column], Column]] = {
    "hinge": lambda z: F.greatest(F.lit(0.0), 1 - z),
    "exponential": lambda z: F.exp(-z),
    "linear": lambda z: -z,
}


def decode_loss(scores: DataFrame, code: DataFrame, loss: str | Callable[[Column], Column] = "hinge") -> DataFrame:
    """Sum of a loss of the margin; ``loss`` may be any Column -> Column function."""
    fn = LOSSES[loss] if isinstance(loss, str) else loss
    return _decode(scores, code, lambda b, s: fn(b * s), None)


def choose_class(decoded: DataFrame, largest: bool = True) -> DataFrame:
    """Winning class per row; ties go to the smallest class."""
    v = F.round("value", 9)
    return decoded.groupBy("row_id").agg(F.min(F.struct((-v if largest else v).alias("s"), "class"))["class"].alias("predicted"))


def nbest(scores: DataFrame, n: int, forced: DataFrame | None = None, key: str = "row_id", cls: str = "class", value: str = "value") -> DataFrame:
    """The ``n`` best classes per row with their rank.

    ``forced(row_id, class)`` puts a class in when it is missing, in place of the
    last one.  Groups are as small as the class domain.
    """
    w = Window.partitionBy(key).orderBy(F.round(value, 9).desc(), cls)
    ranked = scores.withColumn("rank", F.row_number().over(w))
    if forced is None:
        return ranked.filter(F.col("rank") <= n)
    must = forced.select(F.col(key), F.col(cls), F.lit(True).alias("_f"))
    joined = ranked.join(must, [key, cls], "left")
    outside = F.max(F.when(F.col("_f") & (F.col("rank") > n), 1).otherwise(0)).over(Window.partitionBy(key))
    out = joined.withColumn("_o", outside).filter(
        (F.col("rank") <= F.lit(n) - F.col("_o")) | (F.coalesce("_f", F.lit(False)) & (F.col("rank") > n))
    )
    return out.drop("_f", "_o")


def decode_shortlist(scores: DataFrame, code: DataFrame, short: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Wins among the shortlisted classes, using only their pair classifiers.

    ``short(row_id, class)``.  A pair classifier takes part in a row when both of
    its classes are on the row's list.
    """
    g = gather(scores, code)
    lists = short.groupBy("row_id").agg(F.collect_set("class").alias("_short"))
    g = g.join(lists, "row_id")
    g = g.withColumn("_kept", F.filter("_code", lambda c: F.array_contains("_short", c["class"])))
    # a pair classifier is active when both of its non-zero bits are listed
    span = F.sequence(F.lit(1), F.size("_clfs"))
    g = g.withColumn(
        "_active",
        F.transform(span, lambda i: F.size(F.filter("_kept", lambda c: F.element_at(c["bits"], i) != 0)) == 2),
    ).withColumn("_sa", F.arrays_zip("_s", "_active"))

    def wins(c: Column) -> Column:
        hit = F.zip_with(c["bits"], F.col("_sa"), lambda b, z: F.when(z["_active"] & (b == _sign(z["_s"], threshold)), 1).otherwise(0))
        return F.struct(c["class"].alias("class"), F.aggregate(hit, F.lit(0), lambda s, v: s + v).cast("long").alias("value"))

    return g.select("row_id", F.explode(F.transform("_kept", wins)).alias("z")).select("row_id", "z.class", "z.value")


def decode_elimination(scores: DataFrame, code: DataFrame, threshold: float = 0.0) -> DataFrame:
    """All-pairs elimination in classifier order; the first survivor wins.

    ``_pairs`` holds the two classes of every classifier; the fold keeps the set of
    classes that already lost.
    """
    pairs = code.filter(F.col("bit") != 0).groupBy("clf").agg(
        F.max(F.when(F.col("bit") == 1, F.col("class"))).alias("plus"), F.max(F.when(F.col("bit") == -1, F.col("class"))).alias("minus")
    )
    one = pairs.agg(F.array_sort(F.collect_list(F.struct("clf", "plus", "minus"))).alias("_pairs"))
    g = gather(scores, code).join(F.broadcast(one.limit(1)))
    steps = F.arrays_zip("_pairs", "_s")

    def fold(out: Column, z: Column) -> Column:
        p = z["_pairs"]
        skip = F.array_contains(out, p["plus"]) | F.array_contains(out, p["minus"])
        loser = F.when(z["_s"] > threshold, p["minus"]).otherwise(p["plus"])
        return F.when(skip, out).otherwise(F.concat(out, F.array(loser)))

    lost = F.aggregate(steps, F.array().cast("array<string>"), fold)
    names = F.transform("_code", lambda c: c["class"])
    left = F.array_except(names, lost)
    return g.select("row_id", F.try_element_at(left, F.lit(1)).alias("predicted"))


def pairwise_from_class_probs(probs: DataFrame, code: DataFrame) -> DataFrame:
    """Per (row, classifier): ``plus / (plus + minus)``, their sum and the larger one.

    ``probs(row_id, class, p)``.
    """
    rows = probs.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "p"))).alias("_p"))
    sides = code.filter(F.col("bit") != 0).groupBy("clf").agg(
        F.collect_list(F.when(F.col("bit") == 1, F.col("class"))).alias("plus"), F.collect_list(F.when(F.col("bit") == -1, F.col("class"))).alias("minus")
    )
    listed = sides.agg(F.array_sort(F.collect_list(F.struct("clf", F.array_sort("plus").alias("plus"), F.array_sort("minus").alias("minus")))).alias("_c"))
    g = rows.join(F.broadcast(listed.limit(1)))

    def mass(names: Column) -> Column:
        return F.aggregate(F.transform(names, lambda c: F.coalesce(F.try_element_at("_p", c), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)

    z = F.transform("_c", lambda c: F.struct(c["clf"].alias("clf"), mass(c["plus"]).alias("plus"), mass(c["minus"]).alias("minus")))
    flat = g.select("row_id", F.explode(z).alias("z")).select("row_id", "z.*")
    total = F.col("plus") + F.col("minus")
    return flat.select(
        "row_id", "clf", F.when(total > 0, F.col("plus") / total).alias("pairwise"), total.alias("pair_sum"), F.greatest("plus", "minus").alias("pair_max")
    )


def binary_outcome(scores: DataFrame, code: DataFrame, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """1 right, -1 wrong, 0 don't care, for the true class of each row."""
    true_code = labels.select("row_id", F.col("label").alias("class")).join(code, "class")
    sign = _sign(F.col("score"), threshold)
    out = scores.join(true_code, ["row_id", "clf"])
    return out.select("row_id", "clf", F.when(F.col("bit") == 0, 0).when(F.col("bit") == sign, 1).otherwise(-1).alias("outcome"))
