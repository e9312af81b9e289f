"""Ordered work inside keys of any size.

A window partitioned by a key sorts all rows of that key in one task.  When one
key may own a large share of the table that task is the bottleneck, so every
ordered operator here works on pieces of a key: ``split_keys`` cuts a long key
into ordered pieces, running values are taken inside a piece and corrected by
the totals of the pieces before it, and bounded look-back or look-ahead copies
only the border rows into the neighbouring piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.session import cut

PIECE_ROWS = 1_000_000  # rows of one key that a single task may order
MAX_PIECES = 5_000  # resolution of the cut points of one key
MAX_LONG = 10_000  # long keys whose sizes are broadcast


SAMPLES = 20  # sampled rows per piece that place its cut points


def _position(order: Sequence[str], number: str) -> Column:
    """The whole order of a row, of columns of any type; a hash of its written number parts rows that tie, even equal ones."""
    return F.struct(*[F.col(c) for c in order], F.xxhash64(number).alias("_tie"))


TASK_ROWS = 500_000  # rows that one task of a sort or join gets where their number is known


def in_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many tasks as ``rows`` needs; the session's own number is left alone if it is enough."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def key_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of the table: one map-side combined count, two numbers back."""
    found = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return found[0] or 0, found[1] or 0


def longest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key: one map-side combined count, one number back."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def split_keys(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS, longest: int | None = None
) -> tuple[DataFrame, bool]:
    """Add ``_piece``; pieces of one key are ordered by ``order`` and never overlap.

    Cut points are sampled rows, which only balance the pieces: any cut points
    give the same result.  With a long key the rows are numbered and written, and rows that tie in ``order`` are parted by a hash
    of their number.  ``longest`` is the (estimated) size of the largest key if the caller knows it.
    """
    longest = longest_key(df, keys) if longest is None else longest
    if longest <= piece_rows:
        return df.withColumn("_piece", F.lit(0)), False
    pieces = min(MAX_PIECES, -(-longest // piece_rows))
    df = cut(df.withColumn("_number", F.monotonically_increasing_id()))
    position = _position(order, "_number")
    sizes = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > piece_rows)) if keys else None
    rate = F.lit(SAMPLES * pieces) / (F.col("_n") if keys else F.lit(longest))
    named = df.join(F.broadcast(sizes) if sizes.count() <= MAX_LONG else sizes, list(keys)) if keys else df
    chosen = named.withColumn("_at", position).filter(F.pmod(F.xxhash64(F.col("_at")["_tie"]), F.lit(1_000_003)) < rate * 1_000_003)
    spaced = F.array_sort(F.collect_list("_at"))
    step = F.greatest(F.lit(1), F.ceil(F.size("_all") / pieces).cast("int"))
    cuts = chosen.groupBy(*keys).agg(spaced.alias("_all")).select(*keys, F.filter("_all", lambda _, i: i % step == step - 1).alias("_cuts"))
    cuts = cut(cuts)  # written, so that its size is known where it is joined
    joined = df.join(cuts, list(keys), "left") if keys else df.crossJoin(cuts)
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < position)), F.lit(0))
    return joined.withColumn("_piece", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(piece)).drop("_cuts", "_number"), True


def join_sized(rows: DataFrame, table: DataFrame, keys: Sequence[str], size: str, spread: Sequence[str], piece_rows: int = PIECE_ROWS, how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per key that holds the key's number of rows in ``size``.

    The rows of a key of more than ``piece_rows`` rows are dealt by a hash of ``spread`` over as many parts as it needs, and
    the table's row is copied to each part, so no task gets a whole long key.  The long keys are few (the ``MAX_LONG``
    longest) and broadcast with their number of parts; all other keys have one part.
    """
    table = cut(table)
    long = table.filter(F.col(size) > piece_rows).orderBy(F.desc(size), *keys).limit(MAX_LONG).select(*keys, F.ceil(F.col(size) / piece_rows).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(long), list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts)).drop("_parts")
    copies = table.join(F.broadcast(long), list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    total = table.agg(F.sum(size)).first()[0] or 0
    on = [*keys, "_part"]
    return in_tasks(dealt, total, *on).join(in_tasks(copies, total, *on), on, how).drop("_part")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    piece_rows: int = PIECE_ROWS,
    longest: int | None = None,
    next_of: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``totals`` along ``order`` inside ``keys``.

    ``next_of`` maps a new column to the column whose value on the following row
    it takes; that column must grow along ``order`` and hold no nulls.
    """
    longest, rows = key_sizes(df, keys) if longest is None else (longest, 0)
    cut_df, long = split_keys(df, keys, order, piece_rows, longest)
    if keys:
        cut_df = in_tasks(cut_df, rows, *keys, *(["_piece"] if long else []))
    ordered = Window.partitionBy(*keys, "_piece").orderBy(*order)
    inside = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names, leads = list(totals), next_of or {}
    work = cut_df.withColumns({f"_v_{n}": c for n, c in totals.items()})
    out = work.withColumns({**{n: F.sum(f"_v_{n}").over(inside) for n in names}, **{n: F.lead(c).over(ordered) for n, c in leads.items()}})
    if long:
        before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*keys).orderBy("_piece")
        sums = work.groupBy(*keys, "_piece").agg(
            *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names], *[F.min(c).alias(f"_f_{n}") for n, c in leads.items()]
        )
        offsets = sums.select(
            *keys,
            "_piece",
            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
            *[F.lead(f"_f_{n}").over(after).alias(f"_o_{n}") for n in leads],
        )
        out = out.join(offsets, [*keys, "_piece"]).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in names})
        out = out.withColumns({n: F.coalesce(n, f"_o_{n}") for n in leads})
        out = out.drop(*[f"_o_{n}" for n in [*names, *leads]])
    return out.drop("_piece", *[f"_v_{n}" for n in names])


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "t", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """0-based position of every row inside its key (``order`` must be unique per key)."""
    out = running_totals(df, keys, order, {name: F.lit(1).cast("long")}, piece_rows)
    return out.withColumn(name, F.col(name) - 1)


def with_border(
    df: DataFrame, keys: Sequence[str], t: str = "t", reach: int = 1, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Rows in pieces of ``piece_rows`` positions plus copies of the border rows.

    Adds ``_piece`` and ``_own``; take windows over ``(keys, _piece)`` ordered by
    ``t`` and keep the rows with ``_own``.  No piece depends on the key's length.
    """
    step = F.lit(piece_rows)
    low = F.greatest(F.floor((F.col(t) - reach) / step), F.lit(0).cast("long"))
    high = F.floor((F.col(t) + reach) / step)
    return df.withColumn("_piece", F.explode(F.sequence(low, high))).withColumn(
        "_own", F.col("_piece") == F.floor(F.col(t) / step)
    )


def look_around(
    df: DataFrame,
    keys: Sequence[str],
    exprs: dict,
    t: str = "t",
    reach: int = 1,
    piece_rows: int = PIECE_ROWS,
    rows: int = 0,
) -> DataFrame:
    """Add window expressions that look at most ``reach`` rows away.

    ``exprs`` maps a new column to a function of the window specification; ``rows`` is the table's size if the caller knows it.
    """
    w = Window.partitionBy(*keys, "_piece").orderBy(t)
    out = in_tasks(with_border(df, keys, t, reach, piece_rows), rows, *keys, "_piece").withColumns({n: f(w) for n, f in exprs.items()})
    return out.filter("_own").drop("_own", "_piece")


def seeded_rank(
    df: DataFrame, keys: Sequence[str], digest: str, tie: str, name: str = "rank", prefix: int = 3
) -> DataFrame:
    """1-based rank by a hex digest inside ``keys``.

    The digest prefix is the piece: 16**prefix pieces per key, so a class that
    holds most of the table is ranked by many tasks.
    """
    pieces = df.withColumn("_pre", F.substring(F.col(digest), 1, prefix))
    inside = Window.partitionBy(*keys, "_pre").orderBy(digest, tie)
    before = Window.partitionBy(*keys).orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy(*keys, "_pre").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, "_pre", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    left = pieces.withColumn("_r", F.row_number().over(inside))
    return left.join(offsets, [*keys, "_pre"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_r", "_o", "_pre")
