"""One-rule buckets of numeric attributes.

A bucket closes as soon as one class is frequent enough, so where it ends depends on where it begins alone: every distinct
value has a successor, the value at which a bucket that begins there hands over.  Pieces of the ordered values find
all their successors at once; the effect of a piece is a map from the value where the chain of buckets enters it to the value
where it leaves.  Chains from different values soon meet, so these maps are small, and they are joined in rounds that double
their reach.  With its entry known, each piece marks the buckets that begin in it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators.blocks import map_whole_groups
from strandlab.operators.ordering import PIECE_ROWS, dense_index, join_sized, look_around, running_totals
from strandlab.operators.series import shifted
from strandlab.session import cut

PYTHON_ROWS = 65_536  # values of one attribute that a task holds in Python, with their lists
END = -1  # the successor of a bucket that the last value leaves open


def _with_runs(values: DataFrame, piece_rows: int) -> DataFrame:
    """Add ``pure`` (the class of a value that has one class only) and ``runend``, the last value of its run of that class."""
    pure = values.withColumn("pure", F.when(F.size("labels") == 1, F.col("labels")[0]))
    before = look_around(pure, ["attr"], {"_p": lambda w: F.lag("pure").over(w)}, "i", 1, piece_rows)
    change = F.when((F.col("i") > 0) & (F.col("pure").isNull() | ~F.col("pure").eqNullSafe(F.col("_p"))), 1).otherwise(0).cast("long")
    numbered = cut(running_totals(before, ["attr"], ["i"], {"run": change}, piece_rows).drop("_p"))
    ends = numbered.groupBy("attr", "run").agg(F.max("i").alias("runend"), F.count(F.lit(1)).alias("len"))
    return join_sized(numbered, ends, ["attr", "run"], "len", ["i"], piece_rows).drop("run", "len")


def successors(first: int, own: int, labels: list, weights: list, pure: np.ndarray, runend: np.ndarray, least: float, last: int) -> np.ndarray:
    """For each of the first ``own`` values (number ``first`` and on), the number of the value after a bucket that begins there.

    ``END`` if that bucket holds the last value (number ``last``).

    The rows beyond ``own`` are the following values, enough of them that one class reaches ``least`` among them, or all.
    """
    n = len(labels)
    size = np.array([len(x) for x in labels], dtype=np.int64)
    place = np.repeat(np.arange(n), size)
    names, code = np.unique(np.concatenate(labels), return_inverse=True)
    weight = np.concatenate(weights).astype(float)
    order = np.lexsort((place, code))
    c, p, w = code[order], place[order], weight[order]
    upto = np.cumsum(w)
    full = np.searchsorted(upto, upto - w + least)  # where the class of an entry is frequent enough, counted from it
    known = full < len(c)
    known[known] = c[full[known]] == c[known]
    close = np.full(n, n, dtype=np.int64)
    np.minimum.at(close, p[known], p[full[known]])
    close = np.minimum.accumulate(close[::-1])[::-1][:own]  # an entry further right never closes a bucket earlier
    begin = np.flatnonzero(close < n)
    at = close[begin]
    # the classes of the closing value, counted from the bucket's begin: the most frequent one, then the first
    offset = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(begin)), size[at])
    entry = np.arange(len(owner)) - np.repeat(np.cumsum(size[at]) - size[at] - offset[at], size[at])
    reached = np.empty(len(c))
    reached[order] = upto
    start = np.searchsorted(c * (n + 1) + p, code[entry] * (n + 1) + begin[owner])
    count = reached[entry] - (upto - w)[start]
    best = np.lexsort((code[entry], -count, owner))
    best = best[np.flatnonzero(np.diff(owner[best], prepend=-1))] if len(best) else best
    after = at + 1
    inside = np.minimum(after, n - 1)
    wanted = names[code[entry[best]]] if len(best) else names[:0]
    same = (after < n) & (pure[inside] == wanted) if len(best) else np.zeros(0, dtype=bool)
    out = np.full(own, END, dtype=np.int64)
    out[begin] = np.where(same, runend[inside], first + at) + 1
    return np.where(out > last, END, out)


def _jumps(values: DataFrame, reach: int, least: float, piece_rows: int) -> DataFrame:
    """``(attr, _piece, i, next, leave)``: successor of every value, and the first value after its piece that its chain meets."""
    step = F.lit(piece_rows)
    low = F.greatest(F.floor((F.col("i") - reach) / step), F.lit(0).cast("long"))
    ends = cut(values.groupBy("attr").agg(F.max("i").alias("last")))  # one row an attribute
    ahead = values.join(F.broadcast(ends), "attr").withColumn("_piece", F.explode(F.sequence(low, F.floor(F.col("i") / step))))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (attr, piece), g in pdf.groupby(["attr", "_piece"], sort=False):
            first = int(piece) * piece_rows
            own = int((g["i"] < first + piece_rows).sum())
            following = successors(first, own, list(g["labels"]), list(g["weights"]), g["pure"].to_numpy(), g["runend"].to_numpy(np.int64), least, int(g["last"].iloc[0]))
            leave = following.copy()
            while True:
                inside = np.flatnonzero((leave >= 0) & (leave < first + own))
                if not len(inside):
                    break
                leave[inside] = leave[leave[inside] - first]
            out.append(pd.DataFrame({"attr": attr, "_piece": piece, "i": np.arange(first, first + own), "next": following, "leave": leave}))
        return pd.concat(out, ignore_index=True)

    return map_whole_groups(ahead, ["attr", "_piece"], ["i"], work, "attr string, _piece long, i long, next long, leave long")


def _entries(jumps: DataFrame) -> DataFrame:
    """``(attr, x)``: the values where the chain from value 0 enters pieces, in rounds that double the steps taken."""
    reached = cut(jumps.filter("i = 0").select("attr", F.col("i").alias("x")))
    if not jumps.filter("_piece > 0").take(1):
        return reached
    met = reached.unionByName(jumps.filter("leave >= 0").select("attr", F.col("leave").alias("x"))).distinct()
    step = cut(met.join(jumps.select("attr", F.col("i").alias("x"), F.col("leave").alias("to")), ["attr", "x"]))
    known = reached.count()
    while True:
        more = reached.join(step, ["attr", "x"]).filter("to >= 0").select("attr", F.col("to").alias("x"))
        reached = cut(reached.unionByName(more).distinct())
        now = reached.count()
        if now == known:
            return reached
        known = now
        further = step.select("attr", F.col("x").alias("to"), F.col("to").alias("_to"))
        step = cut(step.join(further, ["attr", "to"], "left").select("attr", "x", F.coalesce("_to", F.lit(END).cast("long")).alias("to")))


def _begins(jumps: DataFrame, entries: DataFrame, piece_rows: int) -> DataFrame:
    """``(attr, i)`` of the values where buckets begin."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (attr, piece), g in pdf.groupby(["attr", "_piece"], sort=False):
            first, n = int(piece) * piece_rows, len(g)
            to = g["next"].to_numpy(np.int64) - first
            jump = np.append(np.where((to >= 0) & (to < n), to, n), n)
            seen = np.zeros(n + 1, dtype=bool)
            seen[int(g["x"].iloc[0]) - first] = True
            while True:
                before = np.flatnonzero(seen)
                seen[jump[before]] = True
                if seen.sum() == len(before):
                    break
                jump = jump[jump]
            out.append(pd.DataFrame({"attr": attr, "i": first + np.flatnonzero(seen[:n])}))
        return pd.concat(out, ignore_index=True)

    at = cut(entries.withColumn("_piece", F.floor(F.col("x") / piece_rows)))  # a chain enters a piece once
    return map_whole_groups(jumps.select("attr", "_piece", "i", "next").join(at, ["attr", "_piece"]), ["attr", "_piece"], ["i"], work, "attr string, i long")


def _follow(ties: list, before) -> list:
    """The class of each bucket: that of the bucket before if it is among the most frequent, else the first of these."""
    out = []
    for own in ties:
        before = before if before is not None and before in own else own[0]
        out.append(before)
    return out


def _carried(buckets: DataFrame, kind: str, piece_rows: int) -> DataFrame:
    """Add ``cls``.  A piece of buckets maps the class before it to its last class; only the classes tied in its first
    bucket differ from no class, so a map has few entries, and there is one map for each ``piece_rows`` buckets."""
    rows = cut(buckets.withColumn("_piece", F.floor((F.col("bucket") - 1) / piece_rows).cast("long")))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (attr, piece), g in pdf.groupby(["attr", "_piece"], sort=False):
            ties = [list(t) for t in g["ties"]]
            out += [(attr, piece, before, _follow(ties, before)[-1]) for before in (None, *ties[0])]
        return pd.DataFrame(out, columns=["attr", "_piece", "before", "after"])

    found: list[tuple] = []
    if rows.filter("_piece > 0").take(1):
        maps = map_whole_groups(rows.select("attr", "_piece", "bucket", "ties"), ["attr", "_piece"], ["bucket"], last, f"attr string, _piece long, before {kind}, after {kind}").collect()
        table = {(r["attr"], r["_piece"], r["before"]): r["after"] for r in maps}
        for attr in sorted({a for a, *_ in table}):
            before, piece = None, 0
            while (attr, piece, None) in table:
                found.append((attr, piece, before))
                before, piece = table.get((attr, piece, before), table[attr, piece, None]), piece + 1
    entry = rows.sparkSession.createDataFrame(found, f"attr string, _piece long, before {kind}")

    def classes(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["attr", "_piece"], sort=False):
            before = g["before"].iloc[0]
            out.append(pd.DataFrame({"attr": g["attr"], "bucket": g["bucket"], "cls": _follow([list(t) for t in g["ties"]], None if pd.isna(before) else before)}))
        return pd.concat(out, ignore_index=True)

    named = rows.select("attr", "_piece", "bucket", "ties").join(entry, ["attr", "_piece"], "left")
    cls = map_whole_groups(named, ["attr", "_piece"], ["bucket"], classes, f"attr string, bucket long, cls {kind}")
    return rows.drop("_piece", "ties").join(cls, ["attr", "bucket"])


def one_rule_numeric(
    df: DataFrame, attrs: Sequence[str], label: str = "label", min_bucket: int = 6, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Buckets of every numeric attribute: ``(attr, bucket, low, high, upper, predicted,
    correct, n, rule_correct, best)``.

    A bucket grows by whole distinct values until its majority class has
    ``min_bucket`` rows, then takes values that hold only that class.  A tie with
    the class of the bucket before goes to that class; neighbours of equal class
    are merged.  Missing values form one bucket with null bounds.  The class column may have any number of values.
    """
    clean = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    kind = dict(clean.dtypes)["label"]
    long = clean.unpivot(["label"], [F.col(a).cast("double").alias(a) for a in attrs], "attr", "value")
    cells = long.filter(F.col("value").isNotNull()).groupBy("attr", "value", "label").agg(F.count(F.lit(1)).cast("double").alias("w"))
    lists = cells.groupBy("attr", "value").agg(F.array_sort(F.collect_list(F.struct("label", "w"))).alias("c"))
    per_value = cut(lists.select("attr", "value", F.col("c.label").alias("labels"), F.col("c.w").alias("weights")))
    values = cut(dense_index(per_value, ["attr"], ["value"], "i", piece_rows))
    reach = clean.select("label").distinct().count() * (min_bucket - 1) + 2  # values after which some class has ``min_bucket`` rows, and the next one
    held_rows = min(piece_rows, PYTHON_ROWS)
    jumps = cut(_jumps(_with_runs(values, piece_rows), reach, float(min_bucket), held_rows))
    begins = _begins(jumps, _entries(jumps), held_rows).withColumn("_one", F.lit(1).cast("long"))
    marked = values.join(begins, ["attr", "i"], "left").withColumn("_one", F.coalesce("_one", F.lit(0).cast("long")))
    numbered = cut(running_totals(marked, ["attr"], ["i"], {"bucket": F.col("_one")}, piece_rows).drop("_one"))
    held = numbered.select("attr", "bucket", F.explode(F.arrays_zip("labels", "weights")).alias("z")).groupBy("attr", "bucket", F.col("z.labels").alias("label")).agg(F.sum("z.weights").alias("w"))
    held = held.groupBy("attr", "bucket").agg(F.max("w").alias("correct"), F.sum("w").alias("n"), F.array_sort(F.collect_list(F.struct("label", "w"))).alias("c"))
    held = held.withColumn("ties", F.transform(F.filter("c", lambda x: x["w"] == F.col("correct")), lambda x: x["label"])).drop("c")
    bounds = numbered.groupBy("attr", "bucket").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    raw = cut(_carried(held.join(bounds, ["attr", "bucket"]), kind, held_rows).drop("bucket"))
    prev = shifted(raw, ["attr"], ["low"], {"_p": lambda w: F.lag("cls").over(w)}, 1, piece_rows)
    change = F.when(F.col("_p").isNotNull() & (F.col("_p") != F.col("cls")), 1).otherwise(0).cast("long")
    merged = running_totals(prev, ["attr"], ["low"], {"bucket": change}, piece_rows).groupBy("attr", "bucket").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("cls").alias("predicted"), F.sum("correct").alias("correct"), F.sum("n").alias("n")
    )
    nexts = shifted(merged, ["attr"], ["bucket"], {"_n": lambda w: F.lead("low").over(w)}, 1, piece_rows)
    out = nexts.select("attr", "bucket", "low", "high", ((F.col("high") + F.col("_n")) / 2).alias("upper"), "predicted", "correct", "n")
    gone = long.filter(F.col("value").isNull()).groupBy("attr", "label").agg(F.count(F.lit(1)).cast("double").alias("w"))
    empty = F.lit(None).cast("double")
    missing = gone.groupBy("attr").agg(
        F.min(F.struct((-F.col("w")).alias("s"), "label"))["label"].alias("predicted"), F.max("w").alias("correct"), F.sum("w").alias("n")
    ).select("attr", F.lit(-1).cast("long").alias("bucket"), empty.alias("low"), empty.alias("high"), empty.alias("upper"), "predicted", "correct", "n")
    both = cut(out.unionByName(missing))
    totals = both.groupBy("attr").agg(F.sum("correct").alias("rule_correct"))
    best = totals.agg(F.min(F.struct((-F.col("rule_correct")).alias("s"), "attr"))["attr"].alias("_b"))
    return both.join(totals, "attr").join(F.broadcast(best.limit(1))).withColumn("best", F.col("attr") == F.col("_b")).drop("_b")
