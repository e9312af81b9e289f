"""Streaming queries: the tables are replayed as files of several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.catalog.registry import query
from strandlab.catalog.series_queries import literal_models, VIT
from strandlab.catalog.tables import r6, table
from strandlab.operators.prep import fit_standardize
from strandlab.streaming import stream


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query(
    "stream_counts",
    """
    WITH e AS (SELECT event_type AS label, CAST(hour(ts) AS VARCHAR) AS hour, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS band FROM events),
    l AS (SELECT 'hour' AS attr, hour AS value, label FROM e UNION ALL SELECT 'band', band, label FROM e)
    SELECT attr, value, label, CAST(count(*) AS DOUBLE) AS w FROM l GROUP BY ALL
    """,
)
def _counts(spark, d):
    path = stream.new_path(spark, "counts")

    def run(events):
        src = events.select(
            F.hour("ts").cast("string").alias("hour"), F.floor(F.col("value") / 50).cast("string").alias("band"), F.col("event_type").alias("label")
        )
        return stream.run_counts(src, ["hour", "band"], path)

    return stream.replay(_events(spark, d), "ts", run)


@query("stream_fifo", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _fifo(spark, d):
    path = stream.new_path(spark, "fifo")
    run = lambda e: stream.run_fifo(stream.watermarked(e, "ts", "event_id", "60 days"), "user_id", ["ts", "event_id"], 5, path)
    return stream.replay(_events(spark, d), "ts", run).select("user_id", "event_id", "value")


@query("stream_fifo_range", "SELECT min(value) AS value_lo, max(value) AS value_hi FROM events")
def _fifo_range(spark, d):
    path = stream.new_path(spark, "fifo")
    return stream.replay(_events(spark, d), "ts", lambda e: stream.run_ranges(e, ["value"], path))


@query("stream_translate", "SELECT event_id, v AS value FROM (SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL")
def _translate(spark, d):
    path = stream.new_path(spark, "translate")
    out = stream.replay(_events(spark, d), "ts", lambda e: stream.run_translate(e, "user_id", ["ts", "event_id"], ["value"], -2, path))
    return out.select("event_id", "value")


@query(
    "stream_apply_fitted",
    "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer) SELECT event_id, round((value - m) / sd, 6) AS value FROM events, s",
)
def _fitted(spark, d):
    stats = fit_standardize(table(spark, d, "customer").select(F.col("c_acctbal").alias("value")), ["value"])
    path = stream.new_path(spark, "fitted")
    out = stream.replay(_events(spark, d).select("event_id", "ts", "value"), "ts", lambda e: stream.run_apply_fitted(e, stats, ["value"], path))
    return out.select("event_id", r6(F.col("value")).alias("value"))


def _event_vit() -> str:
    # the events of a user as a sequence of two features: value / 20 and the hour share
    return VIT[: VIT.index("lines AS (")] + """lines AS (
      SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value / 20 AS q, hour(ts) / 24.0::DOUBLE AS d FROM events
    )""" + VIT[VIT.index("FROM lineitem)") + len("FROM lineitem)") :]


@query("stream_viterbi", f"{_event_vit()} SELECT seq_id, model, n, round(total, 5) AS total, round(total / n, 6) AS score FROM sc")
def _viterbi(spark, d):
    path, models = stream.new_path(spark, "viterbi"), literal_models(spark)

    def run(events):
        src = events.withColumns({"q": F.col("value") / 20, "d": F.hour("ts") / F.lit(24.0)})
        return stream.run_viterbi(src, "user_id", ["ts", "event_id"], ["q", "d"], *models, path)

    out = stream.replay(_events(spark, d), "ts", run)
    return out.select("seq_id", "model", "n", r6(F.col("total"), 5).alias("total"), r6(F.col("score")).alias("score"))
