"""Exact nearest rows by cells and bounds.

Training rows lie in cells.  A query first meets its own cell, which bounds its k-th distance.  It then visits only the cells
that can hold a nearer row.  Mixed rows have the cells of ``boxes``.  Vectors lie in the cell of their nearest pivot: with d the distance to a cell's pivot and
[low, high] the distances of the cell's rows, no row of the cell is nearer than d - high, low - d, or half of d less the
distance to the query's own pivot.  The bounds hold for every distance that obeys the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.operators.blocks import pair_blocks
from strandlab.operators.boxes import MAX_LEAVES, SAMPLES, BoxTree, box_stats
from strandlab.session import cut

MAX_PIVOTS = 512  # cells of vectors, and pivots that every task holds
DENSE = 0.25  # share of all rows beyond which visits are not worth while
DENSE_ROWS = 32_768  # rows of a block on either side if all pairs meet
CELLS_PER_BLOCK = 4  # cells for each block of training rows
SLACK = 1e-8  # distances are rounded
STEP = 1024  # rows measured at once

Measure = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
Reduce = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def _by_parts(df: DataFrame, place: Callable[[pd.DataFrame], pd.DataFrame], extra: str, keep: bool = True) -> DataFrame:
    """``place`` over all rows, some at a time; it may repeat rows and adds columns ``extra``, or returns these alone."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), STEP):
                yield place(pdf.iloc[a : a + STEP].reset_index(drop=True))

    return df.mapInPandas(work, ", ".join([*[f"`{c}` {kind}" for c, kind in df.dtypes if keep], extra]))


def _meet(visits: DataFrame, train: DataFrame, sizes: dict[int, int], query_id: str, train_id: Sequence[str], reduce: Reduce, schema: str, rows: int) -> tuple[DataFrame, int]:
    """Run ``reduce`` on (visitors, rows) of every cell, in blocks of about ``rows`` rows on either side; and the pairs met."""
    spark = visits.sparkSession
    visitors = {r["_cell"]: r["count"] for r in visits.groupBy("_cell").count().collect()}  # at most MAX_LEAVES rows or so
    parts = [(c, -(-n // rows), -(-sizes[c] // rows)) for c, n in visitors.items()]
    table = F.broadcast(spark.createDataFrame(parts, "_cell int, _qn int, _tn int"))
    zero = F.lit(0)
    a = visits.join(table, "_cell").withColumn("_qp", F.pmod(F.xxhash64(query_id), F.col("_qn")).cast("int")).withColumn("_tp", F.explode(F.sequence(zero, F.col("_tn") - 1))).drop("_qn", "_tn")
    b = train.join(table, "_cell").withColumn("_tp", F.pmod(F.xxhash64(*train_id), F.col("_tn")).cast("int")).withColumn("_qp", F.explode(F.sequence(zero, F.col("_qn") - 1))).drop("_qn", "_tn")
    keys = ["_cell", "_qp", "_tp"]
    a, b = a.select(*[F.col(c).alias(c) for c in a.columns]), b.select(*[F.col(c).alias(c) for c in b.columns])
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(lambda x, y: reduce(x, y), schema), sum(n * sizes[c] for c, n in visitors.items())


class PivotCells:
    """Cells of the rows nearest to each of at most ``MAX_PIVOTS`` sampled pivots."""

    def __init__(self, train: DataFrame, features: Sequence[str], measure: Measure, train_id: Sequence[str], number: int) -> None:
        self.measure = measure
        self.pivots = train.select(*features).orderBy(F.xxhash64(*train_id, F.lit(17))).limit(min(number, MAX_PIVOTS)).toPandas()

    def place(self, part: pd.DataFrame) -> pd.DataFrame:
        dist = self.measure(part, self.pivots)
        cell = dist.argmin(axis=1).astype(np.int32)
        return part.assign(_cell=cell, _radius=dist[np.arange(len(part)), cell])

    def learn(self, placed: DataFrame) -> dict[int, int]:
        stats = placed.groupBy("_cell").agg(F.min("_radius").alias("low"), F.max("_radius").alias("high"), F.count(F.lit(1)).alias("n")).toPandas().set_index("_cell")
        self.low, self.high = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        self.low[stats.index], self.high[stats.index] = stats["low"], stats["high"]
        self.used = np.isfinite(self.low)
        return {int(c): int(n) for c, n in stats["n"].items()}

    def home(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        dist = self.measure(part, self.pivots)
        return np.arange(len(part)), np.where(self.used, dist, np.inf).argmin(axis=1)

    def reached(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        dist = self.measure(part, self.pivots)
        reach = np.where(self.used, dist, np.inf).min(axis=1, keepdims=True)
        least = np.maximum(np.maximum(dist - self.high, self.low - dist), (dist - reach) / 2)
        return np.nonzero(self.used & (least <= part["_bound"].to_numpy()[:, None] + SLACK))


class BoxCells:
    """Cells of mixed rows: leaves of a ``BoxTree``, whose number grows with the rows."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], nominal: Sequence[str], train_id: Sequence[str], number: int, k: int) -> None:
        self.numeric, self.nominal, self.k = list(numeric), list(nominal), k
        sample = train.select(*numeric, *nominal).orderBy(F.xxhash64(*train_id, F.lit(17))).limit(min(number, MAX_LEAVES) * SAMPLES).toPandas()
        self.tree = BoxTree(sample, numeric, nominal, max(1, -(-len(sample) // min(number, MAX_LEAVES))))

    def place(self, part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(_cell=self.tree.leaf(self.tree.matrix(part)).astype(np.int32), _radius=0.0)

    def learn(self, placed: DataFrame) -> dict[int, int]:
        stats = box_stats(placed, self.numeric, self.nominal).toPandas()
        self.tree.set_boxes(stats)
        return {int(c): int(n) for c, n in zip(stats["_cell"], stats["n"])}

    def home(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return self.tree.home(self.tree.matrix(part), self.k + 1)

    def reached(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return self.tree.reached(self.tree.matrix(part), part["_bound"].to_numpy() + SLACK)


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    build: Callable[[DataFrame, int], PivotCells | BoxCells],
    most: int,
    reduce: Reduce,
    schema: str,
    train_id: Sequence[str],
    rows: int,
    cells: int | None = None,
) -> tuple[DataFrame, int]:
    """Candidates of every query that hold its ``k`` nearest rows with ties, and the number of pairs measured.

    ``build(train, number)`` makes about ``number`` cells, ``most`` at most.  ``reduce(queries, rows)`` gives the
    candidates ``(query, ..., distance, w)`` of a block; a query's ``_bound`` is a distance beyond which it needs none.
    ``w`` counts equal rows.  Any cells give the same candidates up to rows beyond the k-th distance.  Where the queries
    would visit more than ``DENSE`` of all rows on the average, all pairs meet in large blocks, which moves fewer copies.
    """
    train = cut(train)
    total = train.count()
    if not total:
        return queries.sparkSession.createDataFrame([], schema), 0
    number = min(most, cells or max(1, -(-CELLS_PER_BLOCK * total // rows) if total > rows else 1))
    plan = build(train, number)
    placed = cut(_by_parts(train, plan.place, "_cell int, _radius double"))
    sizes = plan.learn(placed)
    placed = placed.drop("_radius")

    def home(part: pd.DataFrame) -> pd.DataFrame:
        i, cell = plan.home(part)
        return part.iloc[i].assign(_cell=cell.astype(np.int32))

    own = cut(_by_parts(queries, home, "_cell int"))
    first, work = _meet(own.withColumn("_bound", F.lit(float("inf"))), placed, sizes, "query", train_id, reduce, schema, rows)
    first = cut(first)
    if len(sizes) == 1:
        return first, work
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = first.withColumn("_n", F.sum("w").over(nearer))
    bound = kept.groupBy("query").agg(F.min(F.when(F.col("_n") >= k, F.col("distance"))).alias("_bound"))
    known = cut(queries.join(bound, "query", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf")))))

    def visited(part: pd.DataFrame) -> pd.DataFrame:
        met = plan.home(part)
        i, cell = plan.reached(part)
        go = ~np.isin(i * np.int64(1 << 32) + cell, met[0] * np.int64(1 << 32) + met[1])
        return part.iloc[i[go]].assign(_cell=cell[go].astype(np.int32))

    weight = np.zeros(max(sizes) + 1)
    weight[list(sizes)] = list(sizes.values())

    def load(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_load": [weight[plan.reached(part)[1]].sum() / len(part)]})

    tried = known.filter(F.pmod(F.xxhash64("query", F.lit(5)), F.lit(max(1, known.count() // 2_000))) == 0)
    share = _by_parts(tried, load, "_load double", keep=False).agg(F.avg("_load")).first()[0] or 0.0
    if share > DENSE * total and total > rows:
        return pair_blocks(known, placed.drop("_cell"), ["query"], train_id, reduce, schema, rows, DENSE_ROWS), known.count() * total
    more, further = _meet(cut(_by_parts(known, visited, "_cell int")), placed, sizes, "query", train_id, reduce, schema, rows)
    return first.unionByName(more), work + further
