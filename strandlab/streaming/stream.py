"""Incremental operators on Structured Streaming.

Counts and fitted filters are native streaming plans.  Operators that need the last
rows of a key or a running state vector keep them in the engine's own state store
(``applyInPandasWithState``), which versions, recovers and replays them.  The rows of
a key in one micro-batch meet in one task, so the size of a micro-batch bounds a hot
key.  Outputs are written under the number of their micro-batch: a replay overwrites
its own rows, and the newest rows of a key count.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlab.operators.counts import to_long
from strandlab.operators.prep import apply_standardize
from strandlab.operators.sequences import LOG0, chain, collect_units, forward, load_batch, one_hot
from strandlab.session import fresh_path, shared_folder


def run_keyed(stream: DataFrame, key: str, advance: Callable[[tuple, Iterator[pd.DataFrame], object], tuple[object, pd.DataFrame]], schema: str, path: str) -> DataFrame:
    """Run ``advance(key, rows, state) -> (state, output)`` over everything available: the outputs with ``_batch``."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, out = advance(name, batches, pickle.loads(state.get[0]) if state.exists else None)
        state.update((pickle.dumps(kept),))
        yield out

    made = stream.groupBy(key).applyInPandasWithState(step, schema, "kept binary", "append", GroupStateTimeout.NoTimeout)

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/out/b={batch}")

    run_batches(made, write, f"{path}/ckpt")
    return stream.sparkSession.read.option("recursiveFileLookup", "true").schema(f"{schema}, _batch long").parquet(f"{path}/out")


def newest(out: DataFrame, key: str) -> DataFrame:
    """The rows of each key from the last micro-batch that had the key."""
    last = out.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return out.join(last, [key, "_batch"]).drop("_batch")


def columns_of(stream: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)


def watermarked(stream: DataFrame, ts: str, row_id: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated rows inside the watermark, which bounds the state of the check.

    Rows later than ``delay`` are dropped by the engine and counted in the query's
    progress (``numRowsDroppedByWatermark``).
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([row_id])


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run everything that is available, one micro-batch after another."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fn).start()
    query.awaitTermination()
    return query


def stream_counts(stream: DataFrame, attrs: Sequence[str], label: str = "label") -> DataFrame:
    """Incremental naive Bayes counts: the streaming form of the contingency table."""
    src = stream.filter(F.col(label).isNotNull()).withColumnRenamed(label, "label")
    return to_long(src, attrs).groupBy("attr", "value", "label").agg(F.count(F.lit(1)).cast("double").alias("w"))


def run_counts(stream: DataFrame, attrs: Sequence[str], path: str, label: str = "label") -> DataFrame:
    """Keep ``path`` at the counts of everything seen and return them.

    Each micro-batch writes the changed cells only; the newest value of a cell wins.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/cells/b={batch}")

    run_batches(stream_counts(stream, attrs, label), write, f"{path}/ckpt", "update")
    cells = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/cells")
    return cells.groupBy("attr", "value", "label").agg(F.max_by("w", "batch").alias("w"))


def run_fifo(stream: DataFrame, key: str, order: Sequence[str], n: int, path: str) -> DataFrame:
    """Latest ``n`` rows per key, whatever the order in which they arrive; a key's state is these rows."""

    def advance(_: tuple, batches: Iterator[pd.DataFrame], kept: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        for rows in batches:  # one Arrow batch at a time
            kept = rows if kept is None else pd.concat([kept, rows])
            kept = kept.sort_values(list(order), ascending=False).head(n)
        return kept, kept

    return newest(run_keyed(stream, key, advance, columns_of(stream), path), key)


def run_ranges(stream: DataFrame, cols: Sequence[str], path: str) -> DataFrame:
    """Running range of columns: one row of limits per micro-batch, combined when read."""

    def write(df: DataFrame, batch: int) -> None:
        limits = [f(F.col(c).cast("double")).alias(f"{c}_{s}") for c in cols for s, f in (("lo", F.min), ("hi", F.max))]
        df.agg(*limits).write.mode("overwrite").parquet(f"{path}/limits/b={batch}")

    run_batches(stream, write, f"{path}/ckpt")
    seen = stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{path}/limits")
    return seen.agg(*[f(f"{c}_{s}").alias(f"{c}_{s}") for c in cols for s, f in (("lo", F.min), ("hi", F.max))])


def run_translate(stream: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], n: int, path: str) -> DataFrame:
    """Translated rows as soon as both rows of a pair have arrived.

    A key keeps its last ``|n|`` rows.  Rows of one micro-batch are put in order;
    rows of a later micro-batch come after all earlier ones.
    """
    reach, names = abs(n), stream.columns

    def advance(_: tuple, batches: Iterator[pd.DataFrame], kept: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values(list(order))[names]
        rows = new if kept is None else pd.concat([kept, new])
        ends = np.arange(max(reach, len(rows) - len(new)), len(rows))  # the later row of a pair is new
        own, other = (ends, ends - reach) if n < 0 else (ends - reach, ends)
        out = rows.iloc[own].reset_index(drop=True)
        for c in cols:
            out[c] = rows[c].iloc[other].to_numpy()
        return rows.tail(reach), out

    return run_keyed(stream, key, advance, columns_of(stream), path).drop("_batch")


def run_apply_fitted(stream: DataFrame, stats: DataFrame, cols: Sequence[str], path: str) -> DataFrame:
    """Standardise a stream with statistics fitted on a first batch (stream-static join)."""
    query = (
        apply_standardize(stream, stats, cols).writeStream.format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_viterbi(stream: DataFrame, key: str, order: Sequence[str], features: Sequence[str], transition: DataFrame, gaussian: DataFrame, path: str) -> DataFrame:
    """Best score of every sequence so far: ``(seq_id, model, n, total, score)``.

    The state of a sequence is one score per model state, which a micro-batch's rows
    move on.
    """
    spark = stream.sparkSession
    chains = {name: chain([u]) for name, u in collect_units(transition, gaussian).items()}
    kind = dict(stream.dtypes)[key]

    def advance(name: tuple, batches: Iterator[pd.DataFrame], kept: dict | None) -> tuple[dict, pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(order))
        frames = pd.DataFrame({"seq_id": 0, "_piece": 0, "x": list(rows[list(features)].to_numpy(float))})
        seen, scores = kept or (0, {m: one_hot(0, len(c.leave)) for m, c in chains.items()})
        scores = {m: forward(load_batch(frames, c), c, scores[m][None], True)[0][0] for m, c in chains.items()}
        out = pd.DataFrame({key: name[0], "model": list(scores), "n": seen + len(rows), "v": list(scores.values())})
        return (seen + len(rows), scores), out

    out = newest(run_keyed(stream, key, advance, f"`{key}` {kind}, model string, n long, v array<double>", path), key)
    ends = spark.createDataFrame([(m, c.leave.tolist()) for m, c in chains.items()], "model string, leave array<double>")
    total = F.array_max(F.zip_with("v", "leave", lambda a, b: a + b))
    out = out.join(ends, "model").select(F.col(key).alias("seq_id"), "model", "n", F.when(total > LOG0 / 2, total).alias("total"))
    return out.withColumn("score", F.col("total") / F.col("n"))


def replay(df: DataFrame, order: str, run: Callable[[DataFrame], object], parts: int = 3):
    """Feed a stored table as ``parts`` arrivals in the order of a time column.

    After every arrival ``run`` continues the same query from its checkpoint, as a
    restarted job would; the result of the last run is returned.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "replay")
    at = F.col(order).cast("timestamp").cast("double")
    cuts = df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)]).alias("c")).first()["c"]
    bounds = [None, *cuts, None]
    result = None
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        part.write.mode("append").parquet(path)
        result = run(spark.readStream.schema(df.schema).parquet(path))
    return result


def new_path(spark: SparkSession, name: str) -> str:
    shared_folder(spark)
    return fresh_path(spark, name)
