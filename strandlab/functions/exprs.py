"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_ZERO = -1e30  # stands in for log(0) where an infinity would spread as NaN


def xlog2(w: Column) -> Column:
    """``w * log2(w)`` with the limit 0 at w = 0."""
    return F.when(w > 0, w * F.log2(w)).otherwise(F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def log_add(a: Column, b: Column) -> Column:
    """``log(exp(a) + exp(b))`` without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``fn``.

    An expression repeated inside a lambda is computed again for every element;
    a lambda variable is not.
    """
    return F.transform(F.array(value), lambda bound: fn(bound))[0]


def log_sum_exp(logs: Column) -> Column:
    """log-sum-exp of an array column."""

    def total(arr: Column) -> Column:
        return let(
            F.array_max(arr),
            lambda top: top + F.log(F.aggregate(arr, F.lit(0.0), lambda s, v: s + F.exp(v - top))),
        )

    return let(logs, total)


def softmax(logs: Column) -> Column:
    """Array of log weights to an array that sums to one."""
    return let(logs, lambda arr: let(log_sum_exp(arr), lambda z: F.transform(arr, lambda v: F.exp(v - z))))


def normalise(values: Column) -> Column:
    def scaled(arr: Column) -> Column:
        total = F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
        return let(total, lambda t: F.transform(arr, lambda v: safe_div(v, t)))

    return let(values, scaled)


def best_label(score: Column, label: Column, digits: int = 9) -> Column:
    """Aggregate: label of the largest score, ties to the smallest label.

    The score is rounded so that sums taken in another order agree on ties.
    """
    return F.min(F.struct((-F.round(score, digits)).alias("s"), label.alias("l")))["l"]


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(
        F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def gaussian_logpdf(x: Column, mean: Column, var: Column) -> Column:
    """Diagonal Gaussian log density of array ``x``; null or NaN gives log zero."""
    quad = F.zip_with(x, mean, lambda a, m: (a - m) * (a - m))
    terms = F.zip_with(quad, var, lambda q, v: q / v + F.log(v))
    s = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    out = -0.5 * (s + F.size(x) * F.lit(math.log(2 * math.pi)))
    return F.when(out.isNull() | F.isnan(out), F.lit(LOG_ZERO)).otherwise(out)


def gaussian_logpdf_full(x: Column, mean: Column, factor: Column) -> Column:
    """Full-covariance Gaussian log density of array ``x``; null or NaN gives log zero.

    ``factor`` holds the rows of the lower Cholesky factor of the covariance, row i with its i + 1 entries.  Forward
    substitution solves the triangular system row by row; its squared norm and the factor's diagonal are the density.
    """
    rows = F.arrays_zip(F.zip_with(x, mean, lambda a, m: a - m).alias("gap"), factor.alias("row"))
    start = F.struct(F.array().cast("array<double>").alias("y"), F.lit(0.0).alias("q"))

    def solve(state: Column, e: Column) -> Column:
        size = F.size(state["y"])
        known = F.aggregate(F.zip_with(state["y"], F.slice(e["row"], 1, size), lambda y, l: y * l), F.lit(0.0), lambda s, v: s + v)
        return let(
            F.struct(((e["gap"] - known) / F.element_at(e["row"], -1)).cast("double").alias("y"), F.element_at(e["row"], -1).alias("d")),
            lambda now: F.struct(F.concat(state["y"], F.array(now["y"])).alias("y"), (state["q"] + now["y"] * now["y"] + 2.0 * F.log(now["d"])).alias("q")),
        )

    out = -0.5 * (F.aggregate(rows, start, solve)["q"] + F.size(x) * F.lit(math.log(2 * math.pi)))
    return F.when(out.isNull() | F.isnan(out) | (F.size(x) != F.size(factor)), F.lit(LOG_ZERO)).otherwise(out)


def normal_interval(x: Column, mean: Column, sd: Column, width: Column) -> Column:
    """Mass of a normal on ``x ± width/2`` by Boole's rule on the density."""
    norm = 1.0 / math.sqrt(2 * math.pi)

    def pdf(point: Column) -> Column:
        z = (point - mean) / sd
        return F.exp(-0.5 * z * z) * norm / sd

    h = width / 4.0
    return (2.0 * h / 45.0) * (
        7.0 * pdf(x - 2 * h) + 32.0 * pdf(x - h) + 12.0 * pdf(x) + 32.0 * pdf(x + h) + 7.0 * pdf(x + 2 * h)
    )


def seeded_hash(row_id: Column, seed: int | str | Column = 0) -> Column:
    """Hex digest that orders rows pseudo-randomly and repeatably."""
    tail = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(row_id.cast("string"), F.lit("|"), tail.cast("string")))


def seeded_uniform(row_id: Column, seed: int | str | Column = 0) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the seeded hash."""
    return F.conv(F.substring(seeded_hash(row_id, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_draw(u: Column, rate: float) -> Column:
    """Inverse Poisson CDF at ``u``, as a sum of step comparisons up to where no 32-bit ``u`` reaches."""
    p, total, steps = math.exp(-rate), 0.0, []
    for k in itertools.count():
        if k > rate and p < 1e-12:
            break
        total += p
        steps.append((u >= F.lit(total)).cast("int"))
        p *= rate / (k + 1)
    out = steps[0]
    for s in steps[1:]:
        out = out + s
    return out


def clean_number(col: Column) -> Column:
    """NaN to NULL: missing values are NULL everywhere in this package."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def parse_ranges(spec: str, n: int, invert: bool = False) -> list[int]:
    """1-based column ranges such as ``first-3,5,last`` to sorted 0-based positions."""

    def position(token: str) -> int:
        token = token.strip().lower()
        value = {"first": 1, "last": n}.get(token)
        value = int(token) if value is None else value
        if not 1 <= value <= n:
            raise ValueError(f"column position {token} is outside 1..{n}")
        return value - 1

    chosen: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        a, b = position(low), position(high or low)
        if a > b:
            raise ValueError(f"reversed range {part}")
        chosen.update(range(a, b + 1))
    return [i for i in range(n) if (i in chosen) != invert]


def columns_in(columns: Sequence[str], spec: str, invert: bool = False) -> list[str]:
    return [columns[i] for i in parse_ranges(spec, len(columns), invert)]
