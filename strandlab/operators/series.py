"""Series and frame operators: windows, runs, segments and state paths.

``frames(seq_id, t, x[, label])`` carry a dense position ``t``.  Bounded look-back
works on pieces of a sequence with copied borders, whole-sequence values come from
aggregates joined back; no operator sorts a whole sequence in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlab.functions.exprs import gaussian_logpdf, safe_div
from strandlab.operators.moments import VAR_FLOOR, per_dim
from strandlab.operators.ordering import PIECE_ROWS, dense_index, join_sized, longest_key, look_around, running_totals
from strandlab.session import cut

STEP = 10_000  # longest array built by one generator row


def explode_range(df: DataFrame, n: Column, name: str) -> DataFrame:
    """0..n-1 per row in two steps, so that no row builds an array of n elements."""
    outer = df.withColumn("_n", n.cast("long")).filter(F.col("_n") > 0)
    outer = outer.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {STEP}"))))
    first = F.col("_c") * STEP
    last = F.least(first + STEP, F.col("_n")) - 1
    return outer.withColumn(name, F.explode(F.sequence(first, last))).drop("_n", "_c")


# -- selection -------------------------------------------------------------------


def sequence_lengths(frames: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"))


def min_frames(frames: DataFrame, n: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Drop sequences shorter than ``n`` frames."""
    return join_sized(frames, sequence_lengths(frames).filter(F.col("len") >= n), ["seq_id"], "len", ["t"], piece_rows, "left_semi")


def skipped_share(frames: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Sequences that ``min_frames`` drops, with their share."""
    lens = sequence_lengths(frames, ["seq_id", *by])
    return lens.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("len") < n).alias("skipped"), F.avg((F.col("len") < n).cast("double")).alias("share")
    )


def min_sequences(labelled: DataFrame, m: int, label: str = "label") -> DataFrame:
    """Drop labels with fewer than ``m`` sequences."""
    enough = labelled.groupBy(label).agg(F.countDistinct("seq_id").alias("_n")).filter(F.col("_n") >= m).select(label)
    return labelled.join(cut(enough), label, "left_semi")


def trim_nonpositive(series: DataFrame, key: str = "key", t: str = "t", v: str = "v", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Cut leading and trailing samples that are not above zero."""
    positive = F.when(F.col(v) > 0, F.col(t))
    ends = series.groupBy(key).agg(F.min(positive).alias("_a"), F.max(positive).alias("_b"), F.count(F.lit(1)).alias("_len")).filter("_a IS NOT NULL")
    return join_sized(series, ends, [key], "_len", [t], piece_rows).filter(F.col(t).between(F.col("_a"), F.col("_b"))).drop("_a", "_b", "_len")


# -- segments --------------------------------------------------------------------


def expand_segments(segments: DataFrame, template: DataFrame) -> DataFrame:
    """Replace each segment by the template rows of its label, order (file, seg_idx, row_idx)."""
    return segments.join(template, "label")


def extract_label_segments(segments: DataFrame, label_map: DataFrame, entry: int) -> DataFrame:
    """Segments whose label is a synonym of ``entry``."""
    wanted = label_map.filter(F.col("entry") == entry).select("label", "canonical")
    return segments.join(wanted, "label")


def attach_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Pair the k-th sequence of a file with its k-th segment: join on (file, seg_idx)."""
    return frames.drop("label").join(segments, ["file", "seg_idx"])


def segment_mismatches(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """(file, seg_idx) present on one side only."""
    a = frames.select("file", "seg_idx").distinct().withColumn("_f", F.lit(True))
    b = segments.select("file", "seg_idx").distinct().withColumn("_s", F.lit(True))
    j = a.join(b, ["file", "seg_idx"], "full_outer").filter(F.col("_f").isNull() | F.col("_s").isNull())
    return j.select("file", "seg_idx", F.when(F.col("_f").isNull(), "no sequence").otherwise("no segment").alias("problem"))


def stretch(frames: DataFrame, target: DataFrame, name: str = "x", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Cut sequences to ``target(seq_id, target_len)`` frames or repeat their last frame."""
    last = frames.groupBy("seq_id").agg(F.max("t").alias("_last"), F.count(F.lit(1)).alias("_len"))
    info = last.join(target, "seq_id")
    kept = join_sized(frames, info, ["seq_id"], "_len", ["t"], piece_rows).filter(F.col("t") < F.col("target_len"))
    more = kept.filter((F.col("t") == F.col("_last")) & (F.col("target_len") > F.col("_last") + 1))
    extra = explode_range(more, F.col("target_len") - F.col("_last") - 1, "_k").withColumn("t", F.col("_last") + 1 + F.col("_k"))
    cols = ["seq_id", "t", F.col("x").alias(name)]
    return kept.select(*cols).unionByName(extra.select(*cols))


def align_and_concat(a: DataFrame, b: DataFrame, target: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Bring both sequences to the target length and concatenate their features."""
    x, y = stretch(a, target, "_xa", piece_rows), stretch(b, target, "_xb", piece_rows)
    return x.join(y, ["seq_id", "t"]).select("seq_id", "t", F.concat("_xa", "_xb").alias("x"))


# -- shifts ----------------------------------------------------------------------


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str], exprs: dict, reach: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Window expressions that look at most ``reach`` rows away inside ``keys``.

    A plain window while every key is short; otherwise positions first and then
    pieces with borders.
    """
    if longest_key(df, keys) <= piece_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: f(w) for n, f in exprs.items()})
    indexed = dense_index(df, keys, order, "_t", piece_rows)
    return look_around(indexed, keys, exprs, "_t", reach, piece_rows).drop("_t")


def translate_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], n: int, fill: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Copy columns from the row ``-n`` back (n < 0) or ``n`` ahead; edge rows are
    dropped unless ``fill``, which keeps them with nulls."""

    def at(c: Column):
        return lambda w: (F.lag(c, -n) if n < 0 else F.lead(c, n)).over(w)

    out = shifted(df, keys, order, {**{f"_s_{c}": at(F.col(c)) for c in cols}, "_has": at(F.lit(1))}, abs(n), piece_rows)
    if not fill:
        out = out.filter(F.col("_has").isNotNull())
    return out.withColumns({c: F.col(f"_s_{c}") for c in cols}).drop("_has", *[f"_s_{c}" for c in cols])


def difference_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], n: int = -1, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Value minus translated value; edge rows are dropped."""

    def at(c: Column):
        return lambda w: (F.lag(c, -n) if n < 0 else F.lead(c, n)).over(w)

    out = shifted(df, keys, order, {**{f"_s_{c}": at(F.col(c)) for c in cols}, "_has": at(F.lit(1))}, abs(n), piece_rows)
    out = out.filter(F.col("_has").isNotNull())
    return out.withColumns({c: F.col(c) - F.col(f"_s_{c}") for c in cols}).drop("_has", *[f"_s_{c}" for c in cols])


def pre_emphasis(frames: DataFrame, a: float = 0.97, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``x[t] - a x[t-1]`` on the first feature; the first sample uses itself as predecessor."""
    out = look_around(frames, ["seq_id"], {"_p": lambda w: F.lag(F.col("x")[0]).over(w)}, "t", 1, piece_rows)
    value = F.col("x")[0] - a * F.coalesce("_p", F.col("x")[0])
    return out.withColumn("x", F.array(value)).drop("_p")


def frame_series(frames: DataFrame, length: int = 400, shift: int = 160) -> DataFrame:
    """Overlapping windows of ``length`` samples every ``shift``; only full windows.

    Every sample is sent to the windows that cover it, so a window is a small
    group of its own and the length of the sequence does not matter.
    """
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("t") - length + 1) / shift))
    last = F.floor(F.col("t") / shift)
    covered = frames.filter(first <= last).select("seq_id", "t", F.col("x")[0].alias("v"), F.explode(F.sequence(first, last)).alias("frame"))
    covered = covered.filter(F.col("t") < F.col("frame") * shift + length)
    g = covered.groupBy("seq_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return g.filter(F.col("n") == length).select("seq_id", F.col("frame").alias("t"), F.transform("s", lambda e: e["v"]).alias("x"))


def frame_energy(frames: DataFrame, floor: float = -50.0, silence_db: float | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Log energy of a frame with a floor; with ``silence_db`` scaled to at most 1.

    The scaled form is ``e - max + 1`` where energies more than ``silence_db``
    below the maximum of their sequence are raised to that level.
    """
    power = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    e = F.when(power > 0, F.greatest(F.log(power), F.lit(floor))).otherwise(F.lit(floor))
    out = frames.withColumn("energy", e)
    if silence_db is None:
        return out
    top = out.groupBy("seq_id").agg(F.max("energy").alias("_top"), F.count(F.lit(1)).alias("_len"))
    low = F.col("_top") - silence_db * math.log(10.0) / 10.0
    return join_sized(out, top, ["seq_id"], "_len", ["t"], piece_rows).withColumn("energy", F.greatest("energy", low) - F.col("_top") + 1.0).drop("_top", "_len")


def center_per_sequence(frames: DataFrame, dims: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Subtract the mean vector of the sequence (aggregate and join back)."""
    means = frames.groupBy("seq_id").agg(per_dim("x", dims, F.avg).alias("_m"), F.count(F.lit(1)).alias("_len"))
    return join_sized(frames, means, ["seq_id"], "_len", ["t"], piece_rows).withColumn("x", F.zip_with("x", "_m", lambda a, m: a - m)).drop("_m", "_len")


def center_per_frame(frames: DataFrame) -> DataFrame:
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    return frames.withColumn("_m", mean).withColumn("x", F.transform("x", lambda v: v - F.col("_m"))).drop("_m")


def _delta(frames: DataFrame, src: str, dst: str, w: int, piece_rows: int) -> DataFrame:
    shifts = {f"_b{i}": (lambda win, i=i: F.lag(src, i).over(win)) for i in range(1, w + 1)}
    shifts |= {f"_f{i}": (lambda win, i=i: F.lead(src, i).over(win)) for i in range(1, w + 1)}
    out = look_around(frames, ["seq_id"], shifts, "t", w, piece_rows)
    # edge replication: the nearest existing frame stands in for a missing one
    back = [F.coalesce(*[F.col(f"_b{j}") for j in range(i, 0, -1)], F.col(src)) for i in range(1, w + 1)]
    ahead = [F.coalesce(*[F.col(f"_f{j}") for j in range(i, 0, -1)], F.col(src)) for i in range(1, w + 1)]
    den = 2.0 * sum(i * i for i in range(1, w + 1))
    total = F.transform(src, lambda v: F.lit(0.0))
    for i in range(1, w + 1):
        diff = F.zip_with(ahead[i - 1], back[i - 1], _scaled_gap(i))
        total = F.zip_with(total, diff, lambda s, v: s + v)
    return out.withColumn(dst, F.transform(total, lambda v: v / den)).drop(*shifts)


def _scaled_gap(i: int):
    def gap(p: Column, q: Column) -> Column:
        return (p - q) * float(i)

    return gap


def delta_features(frames: DataFrame, w: int = 2, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """First and second order regression slopes over ``2w + 1`` frames: ``delta``, ``accel``."""
    return _delta(_delta(frames, "x", "delta", w, piece_rows), "delta", "accel", w, piece_rows)


# -- runs ------------------------------------------------------------------------


def run_lengths(states: DataFrame, state: str = "state", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Runs of equal states: ``(seq_id, run, state, begin, len)``."""
    prev = look_around(states.select("seq_id", "t", F.col(state).alias("state")), ["seq_id"], {"_p": lambda w: F.lag("state").over(w)}, "t", 1, piece_rows)
    change = F.when((F.col("t") > 0) & ~F.col("state").eqNullSafe(F.col("_p")), 1).otherwise(0).cast("long")
    numbered = running_totals(prev, ["seq_id"], ["t"], {"run": change}, piece_rows)
    return numbered.groupBy("seq_id", "run").agg(F.min("state").alias("state"), F.min("t").alias("begin"), F.count(F.lit(1)).alias("len"))


def run_length_encode(states: DataFrame, state: str = "state", sep: str = " ", runs_per_part: int = 1_000, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``state*len`` runs as text: ``(seq_id, part, code)``.

    Part k holds the runs ``k * runs_per_part ...``; joining the parts in order
    gives the whole code, and no row holds an unbounded text.
    """
    runs = run_lengths(states, state, piece_rows)
    part = F.floor(F.col("run") / runs_per_part).alias("part")
    word = F.concat_ws("*", F.col("state").cast("string"), F.col("len").cast("string"))
    g = runs.groupBy("seq_id", part).agg(F.array_sort(F.collect_list(F.struct("run", word.alias("w")))).alias("s"))
    return g.select("seq_id", "part", F.array_join(F.transform("s", lambda e: e["w"]), sep).alias("code"))


def run_length_decode(coded: DataFrame, sep: str = " ", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Inverse of ``run_length_encode``: ``(seq_id, t, state)``."""
    words = coded.select("seq_id", "part", F.posexplode(F.split("code", sep)).alias("k", "w"))
    cut_at = F.length("w") - F.instr(F.reverse("w"), "*")
    runs = words.select("seq_id", "part", "k", F.substring(F.col("w"), F.lit(1), cut_at).alias("state"), F.substring_index("w", "*", -1).cast("long").alias("len"))
    numbered = dense_index(runs.withColumn("_o", F.col("part") * 1_000_000 + F.col("k")), ["seq_id"], ["_o"], "run", piece_rows)
    ends = running_totals(numbered, ["seq_id"], ["run"], {"end": F.col("len")}, piece_rows)
    rows = explode_range(ends, F.col("len"), "_k")
    return rows.select("seq_id", (F.col("end") - F.col("len") + F.col("_k")).alias("t"), "state")


# -- state paths -----------------------------------------------------------------


def uniform_segmentation(frames: DataFrame, k: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """State ``1 + floor(t k / len)``; sequences with fewer than ``k`` frames are skipped."""
    lens = sequence_lengths(frames).filter(F.col("len") >= k)
    return join_sized(frames, lens, ["seq_id"], "len", ["t"], piece_rows).withColumn("state", (F.floor(F.col("t") * k / F.col("len")) + 1).cast("int")).drop("len")


def transition_counts(paths: DataFrame, k: int, model: str = "label", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Transitions ``(model, i, j, n, p)``; 0 is the entry and ``k + 1`` the exit state."""
    nxt = look_around(paths.select("seq_id", F.col(model).alias("model"), "t", "state"), ["seq_id"], {"_n": lambda w: F.lead("state").over(w)}, "t", 1, piece_rows)
    inner = nxt.select("model", F.col("state").alias("i"), F.coalesce("_n", F.lit(k + 1)).alias("j"))
    entry = nxt.filter(F.col("t") == 0).select("model", F.lit(0).alias("i"), F.col("state").alias("j"))
    counts = inner.unionByName(entry).groupBy("model", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("model", "i")))


def expected_durations(transitions: DataFrame) -> DataFrame:
    """``int(0.5 + 1 / (1 - a_ii))`` frames per state; null for a state that never ends."""
    own = transitions.filter(F.col("i") > 0).groupBy("model", "i").agg(F.coalesce(F.max(F.when(F.col("i") == F.col("j"), F.col("p"))), F.lit(0.0)).alias("stay"))
    return own.select("model", F.col("i").alias("state"), "stay", F.floor(0.5 + safe_div(F.lit(1.0), 1.0 - F.col("stay"))).cast("int").alias("duration"))


def state_moments(paths: DataFrame, dims: int, by: Sequence[str] = ("label", "state", "comp"), floor: float = VAR_FLOOR) -> DataFrame:
    """Weight, mean and floored variance per (model, state, component)."""
    g = paths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), per_dim("x", dims, F.avg).alias("mean"), per_dim("x", dims, F.var_pop).alias("var")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*[b for b in by if b != "comp"]))
    return g.withColumns({"weight": share, "var": F.transform("var", lambda v: F.greatest(v, F.lit(floor)))})


def path_scores(paths: DataFrame, transition: DataFrame, gaussian: DataFrame, exit_state: int) -> DataFrame:
    """Per frame log score of a fixed path: emission plus the transition into its state.

    The last frame also pays the transition to ``exit_state``.

    ``paths(seq_id, t, x, state)``, ``transition(i, j, logp)`` and
    ``gaussian(state, mean, var)`` of one single-component model.
    """
    around = {"_i": lambda w: F.lag("state").over(w), "_e": lambda w: F.when(F.lead("state").over(w).isNull(), F.lit(exit_state))}
    paths = cut(paths)  # written, so that its rows are counted without making them again
    prev = look_around(paths, ["seq_id"], around, "t", 1, rows=paths.count())
    prev = prev.withColumn("_i", F.coalesce("_i", F.lit(0)))
    tr = transition.select(F.col("i").alias("_i"), F.col("j").alias("state"), "logp")
    out = transition.filter(F.col("j") == exit_state).select(F.col("i").alias("state"), F.lit(exit_state).alias("_e"), F.col("logp").alias("_x"))
    joined = prev.join(tr, ["_i", "state"], "left").join(out, ["state", "_e"], "left").join(gaussian.select("state", "mean", "var"), "state")
    emission = gaussian_logpdf(F.col("x"), F.col("mean"), F.col("var"))
    leave = F.when(F.col("_e").isNull(), F.lit(0.0)).otherwise(F.coalesce("_x", F.lit(-1e30)))
    return joined.withColumn("step", emission + F.coalesce("logp", F.lit(-1e30)) + leave).drop("_i", "_e", "_x", "logp")


def cumulative_score(paths: DataFrame, transition: DataFrame, gaussian: DataFrame, exit_state: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Running log score along a fixed state path."""
    steps = cut(path_scores(paths, transition, gaussian, exit_state).select("seq_id", "t", "state", "step"))  # sized, then summed
    return running_totals(steps, ["seq_id"], ["t"], {"score": F.col("step")}, piece_rows)


def per_dim_contribution(paths: DataFrame, gaussian: DataFrame) -> DataFrame:
    """Share of every dimension in the log density of a frame: ``(seq_id, t, dim, part)``."""
    j = paths.join(gaussian.select("state", "mean", "var"), "state")
    z = F.arrays_zip("x", "mean", "var")
    flat = j.select("seq_id", "t", "state", F.posexplode(z).alias("dim", "z"))
    gap = F.col("z.x") - F.col("z.mean")
    part = -0.5 * (gap * gap / F.col("z.var") + F.log("z.var") + math.log(2 * math.pi))
    return flat.select("seq_id", "t", "state", "dim", part.alias("part"))


def best_model(scores: DataFrame) -> DataFrame:
    """Best scoring model per sequence; null when no model gave a score."""
    s = F.when(F.col("score") > -1e29, F.round("score", 9))
    g = scores.groupBy("seq_id").agg(F.min(F.when(s.isNotNull(), F.struct((-s).alias("s"), "model", "score"))).alias("b"))
    return g.select("seq_id", F.col("b.model").alias("predicted"), F.col("b.score").alias("score"))
