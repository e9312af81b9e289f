"""Queries over series, segments, state paths and sequence models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandlab.catalog.registry import query
from strandlab.catalog.tables import FRAMES, LINES, LMAP, event_frames, label_map, line_frames, r6, table
from strandlab.operators import sequences, series
from strandlab.plans import evaluate
from strandlab.session import cut

_X = "round(x, 6) AS x"


def _x(df, *keep):
    return df.select(*keep, r6(F.col("x")[0]).alias("x"))


@query("dense_index", f"WITH {FRAMES} SELECT seq_id, t, {_X}, label FROM frames")
def _dense(spark, d):
    return _x(event_frames(spark, d), "seq_id", "t", "label")


@query("min_frames", f"WITH {FRAMES} SELECT seq_id, t FROM frames WHERE seq_id IN (SELECT seq_id FROM frames GROUP BY seq_id HAVING count(*) >= 65)")
def _min_frames(spark, d):
    return series.min_frames(event_frames(spark, d), 65).select("seq_id", "t")


@query(
    "skipped_share",
    f"WITH {LINES}, s AS (SELECT seq_id, count(*) AS n FROM lines GROUP BY seq_id), o AS (SELECT s.*, o_orderstatus AS label FROM s JOIN orders ON o_orderkey = seq_id) "
    "SELECT label, count(*) AS sequences, CAST(sum(CASE WHEN n < 4 THEN 1 ELSE 0 END) AS BIGINT) AS skipped, round(avg(CASE WHEN n < 4 THEN 1.0 ELSE 0.0 END), 6) AS share FROM o GROUP BY label",
)
def _skipped(spark, d):
    return series.skipped_share(labelled_lines(spark, d), 4, ["label"]).withColumn("share", r6(F.col("share")))


@query(
    "min_sequences",
    """
    WITH s AS (SELECT doc_id AS seq_id, lang AS label FROM documents)
    SELECT seq_id, label FROM s WHERE label IN (SELECT label FROM s GROUP BY label HAVING count(DISTINCT seq_id) >= (SELECT count(*) // 5 FROM s))
    """,
)
def _min_seqs(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("label"))
    return series.min_sequences(s, s.count() // 5)


@query(
    "trim_nonpositive",
    f"""
    WITH {FRAMES}, s AS (SELECT seq_id AS key, t, round(x - 60, 6) AS v FROM frames), e AS (SELECT key, min(t) AS a, max(t) AS b FROM s WHERE v > 0 GROUP BY key)
    SELECT key, t, v FROM s JOIN e USING (key) WHERE t BETWEEN a AND b
    """,
)
def _trim(spark, d):
    s = event_frames(spark, d).select(F.col("seq_id").alias("key"), "t", F.round(F.col("x")[0] - 60, 6).alias("v"))
    return series.trim_nonpositive(s)


# -- segments: runs of equal event type ----------------------------------------

RUNS = f"""
{FRAMES}, g AS (SELECT *, t - row_number() OVER (PARTITION BY seq_id, label ORDER BY t) AS isl FROM frames),
rn AS (SELECT seq_id, label, min(t) AS begin_t, count(*) AS len FROM g GROUP BY seq_id, label, isl),
runs AS (SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY begin_t) - 1 AS BIGINT) AS run, label AS state, begin_t, len FROM rn)
"""


def _runs(spark, d):
    return series.run_lengths(event_frames(spark, d), "label")


def _segments(spark, d):
    return _runs(spark, d).select(F.col("seq_id").alias("file"), F.col("run").alias("seg_idx"), F.col("begin"), (F.col("begin") + F.col("len")).alias("end"), F.col("state").alias("label"))


SEGS = f"{RUNS}, segs AS (SELECT seq_id AS file, run AS seg_idx, begin_t AS \"begin\", begin_t + len AS \"end\", state AS label FROM runs)"
_TEMPLATE = [(label, i, float(v * 10 + i)) for v, label in enumerate(("click", "error", "purchase", "signup", "view")) for i in range(v + 1)]
TEMPL = "templ(label, row_idx, v) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in _TEMPLATE) + ")"


@query("run_lengths", f"WITH {RUNS} SELECT seq_id, run, state, begin_t AS \"begin\", len FROM runs")
def _run_lengths(spark, d):
    return _runs(spark, d)


@query("run_length_encode", f"WITH {RUNS} SELECT seq_id, CAST(run // 1000 AS BIGINT) AS part, string_agg(state || '*' || len, ' ' ORDER BY run) AS code FROM runs GROUP BY ALL")
def _rle(spark, d):
    return series.run_length_encode(event_frames(spark, d), "label")


@query("run_length_decode", f"WITH {FRAMES} SELECT seq_id, t, label AS state FROM frames")
def _rld(spark, d):
    return series.run_length_decode(series.run_length_encode(event_frames(spark, d), "label"))


@query("expand_segments", f"WITH {SEGS}, {TEMPL} SELECT file, seg_idx, label, row_idx, v FROM segs JOIN templ USING (label)")
def _expand(spark, d):
    t = spark.createDataFrame(_TEMPLATE, "label string, row_idx int, v double")
    return series.expand_segments(_segments(spark, d), t).select("file", "seg_idx", "label", "row_idx", "v")


@query("extract_label_segments", f"WITH {SEGS}, {LMAP} SELECT file, seg_idx, label, canonical FROM segs JOIN lmap USING (label) WHERE entry = 1")
def _extract(spark, d):
    return series.extract_label_segments(_segments(spark, d), label_map(spark), 1).select("file", "seg_idx", "label", "canonical")


def _file_frames(spark, d):
    """Frames of a file numbered by the run they belong to."""
    from strandlab.operators.ordering import look_around, running_totals

    f = event_frames(spark, d)
    prev = look_around(f, ["seq_id"], {"_p": lambda w: F.lag("label").over(w)}, "t", 1)
    change = F.when((F.col("t") > 0) & (F.col("label") != F.col("_p")), 1).otherwise(0).cast("long")
    out = running_totals(prev, ["seq_id"], ["t"], {"seg_idx": change})
    return out.select(F.col("seq_id").alias("file"), "seg_idx", "t", "x", "label")


@query("attach_segments", f'WITH {SEGS} SELECT seq_id AS file, seg_idx, t, segs.label, "end" - "begin" AS len FROM frames JOIN segs ON file = seq_id AND t >= "begin" AND t < "end"')
def _attach(spark, d):
    out = series.attach_segments(_file_frames(spark, d), _segments(spark, d))
    return out.select("file", "seg_idx", "t", "label", (F.col("end") - F.col("begin")).alias("len"))


@query("segment_mismatches", f"WITH {SEGS} SELECT file, seg_idx, 'no segment' AS problem FROM segs WHERE label = 'error'")
def _mismatch(spark, d):
    return series.segment_mismatches(_file_frames(spark, d), _segments(spark, d).filter("label <> 'error'"))


@query(
    "align_and_concat",
    f"""
    WITH {FRAMES}, b AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY t) - 1 AS t, x FROM frames WHERE label = 'purchase'),
    tl AS (SELECT DISTINCT seq_id FROM frames), sp AS (SELECT seq_id, unnest(range(0, 80)) AS t FROM tl),
    la AS (SELECT seq_id, max(t) AS l FROM frames GROUP BY seq_id), lb AS (SELECT seq_id, max(t) AS l FROM b GROUP BY seq_id)
    SELECT sp.seq_id, sp.t, round(fa.x, 6) AS x1, round(fb.x, 6) AS x2 FROM sp JOIN la ON la.seq_id = sp.seq_id JOIN lb ON lb.seq_id = sp.seq_id
    JOIN frames fa ON fa.seq_id = sp.seq_id AND fa.t = least(sp.t, la.l) JOIN b fb ON fb.seq_id = sp.seq_id AND fb.t = least(sp.t, lb.l)
    """,
)
def _align(spark, d):
    from strandlab.operators.ordering import dense_index

    a = event_frames(spark, d)
    b = dense_index(a.filter("label = 'purchase'").withColumnRenamed("t", "_t0"), ["seq_id"], ["_t0"]).drop("_t0")
    target = a.select("seq_id").distinct().withColumn("target_len", F.lit(80).cast("long"))
    return series.align_and_concat(a, b, target).select("seq_id", "t", r6(F.col("x")[0]).alias("x1"), r6(F.col("x")[1]).alias("x2"))


# -- shifts --------------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


@query("translate_series", "SELECT event_id, v AS value FROM (SELECT event_id, lag(value, 2) OVER w AS v, lag(1, 2) OVER w AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE h IS NOT NULL")
def _translate(spark, d):
    return series.translate_series(_events(spark, d), ["user_id"], ["ts", "event_id"], ["value"], -2).select("event_id", "value")


@query("translate_series_fill", "SELECT event_id, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM events")
def _translate_fill(spark, d):
    return series.translate_series(_events(spark, d), ["user_id"], ["ts", "event_id"], ["value"], 1, fill=True).select("event_id", "value")


@query("difference_series", "SELECT event_id, round(v, 6) AS value FROM (SELECT event_id, value - lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL")
def _difference(spark, d):
    out = series.difference_series(_events(spark, d), ["user_id"], ["ts", "event_id"], ["value"], -1)
    return out.select("event_id", r6(F.col("value")).alias("value"))


@query("pre_emphasis", f"WITH {FRAMES} SELECT seq_id, t, round(x - 0.97 * coalesce(lag(x) OVER (PARTITION BY seq_id ORDER BY t), x), 6) AS x FROM frames")
def _pre(spark, d):
    return _x(series.pre_emphasis(event_frames(spark, d)), "seq_id", "t")


@query(
    "frame_series",
    f"""
    WITH {FRAMES}, f AS (SELECT unnest(range(0, 100)) AS fr),
    c AS (SELECT seq_id, fr, count(*) AS n, list(round(x, 6) ORDER BY t) AS v FROM frames JOIN f ON t >= fr * 16 AND t < fr * 16 + 40 GROUP BY ALL)
    SELECT seq_id, fr AS t, array_to_string(v, ',') AS x FROM c WHERE n = 40
    """,
)
def _frame(spark, d):
    out = series.frame_series(event_frames(spark, d), 40, 16)
    return out.select("seq_id", "t", F.array_join(F.transform("x", lambda v: F.round(v, 6).cast("string")), ",").alias("x"))


_ENERGY = f"WITH {FRAMES}, e AS (SELECT seq_id, t, greatest(ln(x * x), -1.0) AS e FROM frames)"


@query("frame_energy", f"{_ENERGY} SELECT seq_id, t, round(e, 6) AS energy FROM e")
def _energy(spark, d):
    out = series.frame_energy(event_frames(spark, d), -1.0)
    return out.select("seq_id", "t", r6(F.col("energy")).alias("energy"))


@query(
    "frame_energy_normalised",
    f"{_ENERGY}, m AS (SELECT *, max(e) OVER (PARTITION BY seq_id) AS mx FROM e) SELECT seq_id, t, round(greatest(e, mx - 50.0::DOUBLE * {math.log(10) / 10!r}::DOUBLE) - mx + 1, 6) AS energy FROM m",
)
def _energy_norm(spark, d):
    out = series.frame_energy(event_frames(spark, d), -1.0, silence_db=50.0)
    return out.select("seq_id", "t", r6(F.col("energy")).alias("energy"))


@query("center_per_sequence", f"WITH {FRAMES} SELECT seq_id, t, round(x - avg(x) OVER (PARTITION BY seq_id), 9) AS x FROM frames")
def _center(spark, d):
    return series.center_per_sequence(event_frames(spark, d), 1).select("seq_id", "t", r6(F.col("x")[0], 9).alias("x"))


@query("center_per_frame", f"WITH {LINES} SELECT seq_id, t, round(q - (q + d) / 2, 6) AS q, round(d - (q + d) / 2, 6) AS d FROM lines")
def _center_frame(spark, d):
    return series.center_per_frame(line_frames(spark, d)).select("seq_id", "t", r6(F.col("x")[0]).alias("q"), r6(F.col("x")[1]).alias("d"))


def _delta_sql(src: str, dst: str, table_: str) -> str:
    w = "OVER (PARTITION BY seq_id ORDER BY t)"
    b1, f1 = f"coalesce(lag({src}, 1) {w}, {src})", f"coalesce(lead({src}, 1) {w}, {src})"
    b2, f2 = f"coalesce(lag({src}, 2) {w}, lag({src}, 1) {w}, {src})", f"coalesce(lead({src}, 2) {w}, lead({src}, 1) {w}, {src})"
    return f"SELECT *, (({f1} - {b1}) + 2 * ({f2} - {b2})) / 10.0 AS {dst} FROM {table_}"


@query("delta_features", f"WITH {FRAMES}, d1 AS ({_delta_sql('x', 'dx', 'frames')}), d2 AS ({_delta_sql('dx', 'ax', 'd1')}) SELECT seq_id, t, round(dx, 6) AS delta, round(ax, 6) AS accel FROM d2")
def _deltas(spark, d):
    out = series.delta_features(event_frames(spark, d))
    return out.select("seq_id", "t", r6(F.col("delta")[0]).alias("delta"), r6(F.col("accel")[0]).alias("accel"))


# -- state paths ---------------------------------------------------------------


def labelled_lines(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq_id"), F.col("o_orderstatus").alias("label"))
    return line_frames(spark, d).join(o, "seq_id")


USEG = f"""
{LINES}, ln AS (SELECT seq_id, count(*) AS n FROM lines GROUP BY seq_id HAVING count(*) >= 3),
useg AS (SELECT lines.*, CAST(1 + floor(t * 3 / n) AS INTEGER) AS state, n, o_orderstatus AS label FROM lines JOIN ln USING (seq_id) JOIN orders ON o_orderkey = seq_id)
"""


def _paths(spark, d):
    return series.uniform_segmentation(labelled_lines(spark, d), 3)


@query("uniform_segmentation", f"WITH {USEG} SELECT seq_id, t, label, state FROM useg".replace("t * 3 / n", "t * 3 // n"))
def _useg(spark, d):
    return _paths(spark, d).select("seq_id", "t", "label", "state")


USEG = USEG.replace("t * 3 / n", "t * 3 // n")
TRANS = f"""
{USEG}, mv AS (SELECT label, state AS i, coalesce(lead(state) OVER (PARTITION BY seq_id ORDER BY t), 4) AS j FROM useg UNION ALL SELECT label, 0, state FROM useg WHERE t = 0),
tc AS (SELECT label AS model, i, j, count(*) AS n FROM mv GROUP BY ALL), tr AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY model, i) AS p FROM tc)
"""


@query("transition_counts", f"WITH {TRANS} SELECT model, i, j, n, round(p, 6) AS p FROM tr")
def _transitions(spark, d):
    return series.transition_counts(_paths(spark, d), 3).withColumn("p", r6(F.col("p")))


@query("expected_durations", f"WITH {TRANS}, s AS (SELECT model, i AS state, coalesce(max(CASE WHEN i = j THEN p END), 0) AS stay FROM tr WHERE i > 0 GROUP BY ALL) SELECT model, state, round(stay, 6) AS stay, CAST(floor(0.5 + 1 / (1 - stay)) AS INTEGER) AS duration FROM s")
def _durations(spark, d):
    out = series.expected_durations(series.transition_counts(_paths(spark, d), 3))
    return out.withColumn("stay", r6(F.col("stay")))


@query(
    "state_moments",
    f"WITH {USEG} SELECT label, state, count(*) AS n, round(avg(q), 6) AS m1, round(avg(d), 6) AS m2, round(greatest(var_pop(q), 1e-4), 6) AS v1, round(greatest(var_pop(d), 1e-4), 6) AS v2 FROM useg GROUP BY ALL",
)
def _state_moments(spark, d):
    out = series.state_moments(_paths(spark, d), 2, ["label", "state"])
    cols = [r6(F.col(c)[i]).alias(f"{c[0]}{i + 1}") for c in ("mean", "var") for i in range(2)]
    return out.select("label", "state", "n", *cols)


# literal two-state models over two features
_MODELS = {
    "low": ([(0, 1, 0.8), (0, 2, 0.2), (1, 1, 0.6), (1, 2, 0.3), (1, 3, 0.1), (2, 1, 0.1), (2, 2, 0.5), (2, 3, 0.4)], [(1.5, 0.4, 1.0, 0.2), (3.0, 0.6, 0.8, 0.1)]),
    "high": ([(0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.4), (1, 2, 0.4), (1, 3, 0.2), (2, 1, 0.3), (2, 2, 0.4), (2, 3, 0.3)], [(4.0, 0.5, 1.2, 0.3), (2.0, 0.2, 1.5, 0.2)]),
}


def literal_models(spark):
    t = [(m, i, j, math.log(p)) for m, (arcs, _) in _MODELS.items() for i, j, p in arcs]
    g = [(m, s + 1, 0, 0.0, [a, b], [va, vb]) for m, (_, st) in _MODELS.items() for s, (a, b, va, vb) in enumerate(st)]
    return (
        spark.createDataFrame(t, "model string, i int, j int, logp double"),
        spark.createDataFrame(g, "model string, state int, comp int, logw double, mean array<double>, var array<double>"),
    )


def _model_sql() -> str:
    rows = []
    for m, (arcs, st) in _MODELS.items():
        p = {(i, j): math.log(v) for i, j, v in arcs}
        vals = [p[k] for k in ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3))] + [v for s in st for v in s]
        rows.append(f"('{m}', " + ", ".join(f"{v!r}::DOUBLE" for v in vals) + ")")
    return "mdl(model, e1, e2, a11, a12, x1, a21, a22, x2, q1, d1, vq1, vd1, q2, d2, vq2, vd2) AS (VALUES " + ", ".join(rows) + ")"


def _emit(s: int) -> str:
    return f"-0.5 * (power(q - q{s}, 2) / vq{s} + power(d - d{s}, 2) / vd{s} + ln(vq{s}) + ln(vd{s}) + 2 * ln(2 * pi()))"


VIT = f"""
WITH RECURSIVE {LINES}, {_model_sql()}, em AS (SELECT seq_id, t, mdl.*, {_emit(1)} AS b1, {_emit(2)} AS b2 FROM lines CROSS JOIN mdl),
v AS (SELECT seq_id, model, t, e1 + b1 AS s1, e2 + b2 AS s2 FROM em WHERE t = 0
  UNION ALL SELECT em.seq_id, em.model, em.t, greatest(v.s1 + a11, v.s2 + a21) + b1, greatest(v.s1 + a12, v.s2 + a22) + b2 FROM v JOIN em ON em.seq_id = v.seq_id AND em.model = v.model AND em.t = v.t + 1),
la AS (SELECT seq_id, max(t) AS l FROM lines GROUP BY seq_id),
sc AS (SELECT v.seq_id, v.model, l + 1 AS n, greatest(s1 + x1, s2 + x2) AS total FROM v JOIN la ON la.seq_id = v.seq_id AND l = t JOIN mdl ON mdl.model = v.model)
"""


@query("viterbi_score", f"{VIT} SELECT seq_id, model, n, round(total, 6) AS total, round(total / n, 6) AS score FROM sc")
def _viterbi(spark, d):
    out = sequences.viterbi_score(line_frames(spark, d), *literal_models(spark))
    return out.select("seq_id", "model", "n", r6(F.col("total")).alias("total"), r6(F.col("score")).alias("score"))


@query("best_model", f"{VIT} SELECT seq_id, model AS predicted, round(total / n, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY round(total / n, 9) DESC, model) = 1")
def _best(spark, d):
    out = series.best_model(sequences.viterbi_score(line_frames(spark, d), *literal_models(spark)))
    return out.withColumn("score", r6(F.col("score")))


@query("viterbi_path")
def _vpath(spark, d):
    t, g = literal_models(spark)
    frames = line_frames(spark, d).withColumn("label", F.lit("low"))
    out = sequences.viterbi_path(frames, t, g)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("frames"))


def _fixed_path(spark, d):
    """State 1 in the first half of a sequence, state 2 after it, on the model ``low``."""
    t, g = literal_models(spark)
    paths = series.uniform_segmentation(line_frames(spark, d), 2).select("seq_id", "t", "x", "state")
    return paths, t.filter("model = 'low'").drop("model"), g.filter("model = 'low'")


_PATH = f"""
WITH {LINES}, {_model_sql()}, ln AS (SELECT seq_id, count(*) AS n FROM lines GROUP BY seq_id HAVING count(*) >= 2),
ph AS (SELECT lines.*, n, CAST(1 + (t * 2) // n AS INTEGER) AS state FROM lines JOIN ln USING (seq_id)),
pe AS (SELECT ph.*, mdl.* EXCLUDE (model), CASE state WHEN 1 THEN {_emit(1)} ELSE {_emit(2)} END AS b, lag(state) OVER (PARTITION BY seq_id ORDER BY t) AS pv FROM ph, mdl WHERE model = 'low'),
st AS (SELECT *, b + CASE WHEN pv IS NULL THEN CASE state WHEN 1 THEN e1 ELSE e2 END WHEN pv = 1 AND state = 1 THEN a11 WHEN pv = 1 THEN a12 WHEN state = 1 THEN a21 ELSE a22 END
  + CASE WHEN t = n - 1 THEN CASE state WHEN 1 THEN x1 ELSE x2 END ELSE 0 END AS step FROM pe)
"""


@query("cumulative_score", f"{_PATH} SELECT seq_id, t, round(sum(step) OVER (PARTITION BY seq_id ORDER BY t), 6) AS score FROM st")
def _cumulative(spark, d):
    paths, t, g = _fixed_path(spark, d)
    return series.cumulative_score(paths, t, g, 3).select("seq_id", "t", r6(F.col("score")).alias("score"))


@query(
    "per_dim_contribution",
    f"""
    {_PATH} SELECT seq_id, t, 0 AS dim, round(-0.5 * (CASE state WHEN 1 THEN power(q - q1, 2) / vq1 + ln(vq1) ELSE power(q - q2, 2) / vq2 + ln(vq2) END + ln(2 * pi())), 6) AS part FROM st
    UNION ALL SELECT seq_id, t, 1, round(-0.5 * (CASE state WHEN 1 THEN power(d - d1, 2) / vd1 + ln(vd1) ELSE power(d - d2, 2) / vd2 + ln(vd2) END + ln(2 * pi())), 6) FROM st
    """,
)
def _contribution(spark, d):
    paths, _, g = _fixed_path(spark, d)
    return series.per_dim_contribution(paths, g).select("seq_id", "t", "dim", r6(F.col("part")).alias("part"))


# -- trained sequence models ---------------------------------------------------


def _start(spark, d):
    frames = cut(labelled_lines(spark, d))  # read by the segmentation, the lengths and every training
    return frames, *[cut(t) for t in sequences.initial_models(frames, 2, 2)]


# forward-backward sums of two-state models started from a uniform segmentation
@query(
    "initial_models",
    f"""
    WITH {LINES}, ln AS (SELECT seq_id, count(*) AS n FROM lines GROUP BY seq_id HAVING count(*) >= 2),
    us AS (SELECT lines.*, CAST(1 + (t * 2) // n AS INTEGER) AS state, o_orderstatus AS label FROM lines JOIN ln USING (seq_id) JOIN orders ON o_orderkey = seq_id)
    SELECT label AS model, state, round(avg(q), 6) AS m1, round(avg(d), 6) AS m2, round(var_pop(q), 6) AS v1, round(var_pop(d), 6) AS v2 FROM us GROUP BY ALL
    """,
)
def _initial(spark, d):
    _, _, g = _start(spark, d)
    return g.select("model", "state", *[r6(F.col(c)[i]).alias(f"{c[0]}{i + 1}") for c in ("mean", "var") for i in range(2)])


def _show(gaussian):
    return gaussian.select("model", "state", "comp", r6(F.exp("logw"), 4).alias("weight"), r6(F.col("mean")[0], 4).alias("m1"), r6(F.col("mean")[1], 4).alias("m2"))


@query("segmental_kmeans")
def _segk(spark, d):
    t, g, _ = sequences.segmental_kmeans(labelled_lines(spark, d), 2, 2)
    return _show(g)


def _fb_sql() -> str:
    """Forward-backward on the literal models: occupancy and mean per state."""
    return f"""
    WITH RECURSIVE {LINES}, {_model_sql()}, em AS (SELECT seq_id, t, q, d, mdl.* EXCLUDE (q1, d1, q2, d2), {_emit(1)} AS b1, {_emit(2)} AS b2 FROM lines CROSS JOIN mdl WHERE model = 'low'),
    la AS (SELECT seq_id, max(t) AS l FROM lines GROUP BY seq_id),
    f AS (SELECT seq_id, t, e1 + b1 AS s1, e2 + b2 AS s2 FROM em WHERE t = 0
      UNION ALL SELECT em.seq_id, em.t, b1 + ln(exp(f.s1 + a11 - greatest(f.s1, f.s2)) + exp(f.s2 + a21 - greatest(f.s1, f.s2))) + greatest(f.s1, f.s2),
        b2 + ln(exp(f.s1 + a12 - greatest(f.s1, f.s2)) + exp(f.s2 + a22 - greatest(f.s1, f.s2))) + greatest(f.s1, f.s2) FROM f JOIN em ON em.seq_id = f.seq_id AND em.t = f.t + 1),
    g AS (SELECT la.seq_id, l AS t, x1 AS s1, x2 AS s2 FROM la, mdl WHERE model = 'low'
      UNION ALL SELECT em.seq_id, em.t - 1, ln(exp(a11 + b1 + g.s1) + exp(a12 + b2 + g.s2)), ln(exp(a21 + b1 + g.s1) + exp(a22 + b2 + g.s2)) FROM g JOIN em ON em.seq_id = g.seq_id AND em.t = g.t AND em.t > 0),
    z AS (SELECT f.seq_id, ln(exp(s1 + x1) + exp(s2 + x2)) AS z FROM f JOIN la ON la.seq_id = f.seq_id AND l = t, mdl WHERE model = 'low'),
    gm AS (SELECT lines.q, lines.d, exp(f.s1 + g.s1 - z) AS g1, exp(f.s2 + g.s2 - z) AS g2 FROM f JOIN g ON g.seq_id = f.seq_id AND g.t = f.t JOIN z ON z.seq_id = f.seq_id JOIN lines ON lines.seq_id = f.seq_id AND lines.t = f.t)
    """


@query(
    "baum_welch_step",
    f"""
    {_fb_sql()} SELECT 'low' AS model, 1 AS state, round(sum(g1 * q) / sum(g1), 5) AS m1, round(sum(g1 * d) / sum(g1), 5) AS m2,
      round(sum(g1 * q * q) / sum(g1) - power(sum(g1 * q) / sum(g1), 2), 5) AS v1, round(sum(g1 * d * d) / sum(g1) - power(sum(g1 * d) / sum(g1), 2), 5) AS v2 FROM gm
    UNION ALL SELECT 'low', 2, round(sum(g2 * q) / sum(g2), 5), round(sum(g2 * d) / sum(g2), 5),
      round(sum(g2 * q * q) / sum(g2) - power(sum(g2 * q) / sum(g2), 2), 5), round(sum(g2 * d * d) / sum(g2) - power(sum(g2 * d) / sum(g2), 2), 5) FROM gm
    """,
)
def _bw(spark, d):
    t, g = literal_models(spark)
    frames = line_frames(spark, d).withColumn("label", F.lit("low"))
    _, new, _ = sequences.baum_welch_step(frames, t.filter("model = 'low'"), g.filter("model = 'low'"))
    return new.select("model", "state", *[r6(F.col(c)[i], 5).alias(f"{c[0]}{i + 1}") for c in ("mean", "var") for i in range(2)])


@query(
    "occupation_stats",
    f"""
    {_fb_sql()} SELECT 'low' AS model, 1 AS state, round(sum(g1), 4) AS occupancy, CAST((SELECT count(*) FROM la) AS DOUBLE) AS examples FROM gm
    UNION ALL SELECT 'low', 2, round(sum(g2), 4), CAST((SELECT count(*) FROM la) AS DOUBLE) FROM gm
    """,
)
def _occ(spark, d):
    t, g = literal_models(spark)
    frames = line_frames(spark, d).withColumn("label", F.lit("low"))
    _, _, stats = sequences.baum_welch_step(frames, t.filter("model = 'low'"), g.filter("model = 'low'"))
    out = sequences.occupation_stats(stats)
    return out.select("model", "state", r6(F.col("occupancy"), 4).alias("occupancy"), r6(F.col("examples"), 4).alias("examples"))


@query("baum_welch_fit")
def _bw_fit(spark, d):
    frames, t, g = _start(spark, d)
    return _show(sequences.baum_welch_fit(frames, t, g)[1])


@query("grow_mixtures")
def _grow(spark, d):
    frames, t, g = _start(spark, d)
    return _show(sequences.grow_mixtures(frames, t, g, 2)[1])


@query("embedded_baum_welch_step")
def _embedded(spark, d):
    """Orders are chains of two labels: status, then priority class."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq_id"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    labels = o.select("seq_id", F.posexplode(F.array("o_orderstatus", F.concat(F.lit("P"), "p"))).alias("pos", "label"))
    frames = line_frames(spark, d)
    halves = series.uniform_segmentation(frames, 2).join(labels.withColumn("state", F.col("pos") + 1), ["seq_id", "state"])
    t, g = sequences.single_state_models(halves, 2)
    return _show(sequences.embedded_step(frames, labels, t, g)[1])


@query("classify_sequences")
def _classify(spark, d):
    frames, t, g = _start(spark, d)
    preds = sequences.classify_sequences(frames, t, g, min_len=2)
    return evaluate.confusion_matrix(preds, ["F", "O", "P"])
