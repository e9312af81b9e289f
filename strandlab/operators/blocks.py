"""Grouped and pairwise work in bounded blocks for steps that need numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2_048
SPREAD_BLOCKS = 12  # blocks of a side that are enough to keep a cluster busy


def map_whole_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Call ``fn`` on Arrow batches that hold only whole groups, rows in order.

    Many short groups share one call, which avoids a Python round trip per
    group.  Groups must be bounded by the caller (pieces of a sequence).
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = batch[keys].iloc[-1]
            same = (batch[keys] == last).all(axis=1).to_numpy()
            begin = len(batch) - int(same[::-1].argmin()) if not same.all() else 0
            if begin == 0 and held and (held[-1][keys].iloc[-1] == last).all():
                held.append(batch)
                continue
            ready = held + ([batch.iloc[:begin]] if begin else [])
            held = [batch.iloc[begin:]]
            if ready:
                yield fn(pd.concat(ready, ignore_index=True))
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


def pair_blocks(
    left: DataFrame,
    right: DataFrame,
    left_id: Sequence[str],
    right_id: Sequence[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    rows: int = BLOCK_ROWS,
    most: int | None = None,
) -> DataFrame:
    """Run ``fn`` on every (left block, right block); blocks hold about ``rows`` rows.

    With ``most`` the blocks of a side of more than ``SPREAD_BLOCKS`` blocks grow up to that many rows instead: every row is copied
    to each block of the other side, so larger blocks move fewer copies.

    ``fn`` must reduce a block pair (best matches, partial sums), so no pair of
    rows is ever written out.  Block numbers come from a hash of the ids: equal
    features do not pile up in one block.
    """
    n_left, n_right = (max(1, -(-n // rows)) for n in (left.count(), right.count()))
    if most:
        n_left, n_right = (max(min(n, SPREAD_BLOCKS), -(-n * rows // most)) for n in (n_left, n_right))
    # new column identities: both sides often come from one table
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    a = left.withColumn("_lb", F.pmod(F.xxhash64(*left_id), F.lit(n_left))).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long")))
    )
    b = right.withColumn("_rb", F.pmod(F.xxhash64(*right_id), F.lit(n_right))).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long")))
    )

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return fn(x.drop(columns=["_lb", "_rb"]), y.drop(columns=["_lb", "_rb"]))

    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")).applyInPandas(run, schema)
