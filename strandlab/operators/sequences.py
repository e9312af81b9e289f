"""Hidden-state sequence models over frame tables.

A model is two small tables: ``transition(model, i, j, logp)`` with entry state 0
and exit state n + 1, and ``gaussian(model, state, comp, logw, mean, var)``.

One sequence may be far longer than a task can hold, so recursions run on pieces
of a sequence.  The effect of a piece on the state scores is a small matrix;
matrices of consecutive pieces multiply associatively, first inside groups of
pieces, then over the groups.  Going down again gives every piece its entry and
exit conditions, and the pieces finish independently.  Short sequences are a
single piece and skip all of this: a training packs them into blocks once, frame
after frame of many sequences, and its rounds read the blocks without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators.blocks import map_whole_groups
from strandlab.operators.ordering import join_sized
from strandlab.operators.mixture import split_heaviest
from strandlab.operators.moments import VAR_FLOOR, class_mean_var
from strandlab.operators.rowblocks import FILE_CHUNKS, codes_of
from strandlab.operators.series import best_model, state_moments, transition_counts, uniform_segmentation
from strandlab.session import cut, fresh_path

LOG0 = -1e30
PIECE = 2_048  # frames per piece
FAN = 256  # pieces combined by one group
MODEL_ROWS = 200_000  # rows of one batch of models held by a task
MAX_STATES = 512  # states of one composite model


# -- models as arrays --------------------------------------------------------------


@dataclass
class Unit:
    """Arrays of one model: transitions, and mixtures padded to a common size."""

    name: str
    trans: np.ndarray  # (n + 2, n + 2)
    logw: np.ndarray  # (n, k)
    mean: np.ndarray  # (n, k, d)
    var: np.ndarray  # (n, k, d)

    @property
    def size(self) -> int:
        return len(self.logw)

    def component_logs(self, x: np.ndarray) -> np.ndarray:
        """(frames, states, components) of log weight + log density."""
        out = np.empty((len(x), *self.logw.shape))
        const = self.logw - 0.5 * (np.log(self.var).sum(2) + self.mean.shape[2] * np.log(2 * np.pi))
        for a in range(0, len(x), 4_096):
            gap = x[a : a + 4_096, None, None, :] - self.mean
            out[a : a + 4_096] = const - 0.5 * (gap * gap / self.var).sum(3)
        return np.where(np.isnan(out), LOG0, np.maximum(out, LOG0))


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top
    return np.squeeze(out, axis)


@dataclass
class Chain:
    """Units in a row: state 0 is the entry, then the emitting states in order."""

    step: np.ndarray  # (s + 1, s + 1)
    leave: np.ndarray  # (s + 1,) log probability of leaving the chain
    units: list[Unit]
    owner: list[tuple[int, int]]  # emitting state -> (position of its unit, state in it)


def chain(units: Sequence[Unit]) -> Chain:
    """Join units: leaving one unit enters the next one."""
    sizes = [u.size for u in units]
    total = sum(sizes)
    if total > MAX_STATES:
        raise ValueError(f"a chain of {total} states is longer than {MAX_STATES}; split the transcript")
    step = np.full((total + 1, total + 1), LOG0)
    leave = np.full(total + 1, LOG0)
    at, owner = 1, []
    for p, u in enumerate(units):
        n = u.size
        step[at : at + n, at : at + n] = u.trans[1 : n + 1, 1 : n + 1]
        owner += [(p, s) for s in range(n)]
        if p == 0:
            step[0, at : at + n] = u.trans[0, 1 : n + 1]
        else:
            q = units[p - 1].size
            out = units[p - 1].trans[1 : q + 1, q + 1]
            step[at - q : at, at : at + n] = np.maximum(out[:, None] + u.trans[0, 1 : n + 1][None, :], LOG0)
        if p == len(units) - 1:
            leave[at : at + n] = u.trans[1 : n + 1, n + 1]
        at += n
    return Chain(step, leave, list(units), owner)


def collect_units(transition: DataFrame, gaussian: DataFrame) -> dict[str, Unit]:
    """Model tables (bounded by models x states x components) as arrays."""
    g = gaussian.limit(MODEL_ROWS + 1).toPandas()
    t = transition.limit(MODEL_ROWS + 1).toPandas()
    if len(g) > MODEL_ROWS or len(t) > MODEL_ROWS:
        raise ValueError("too many models for one batch; use model_batches")
    return units_from(t, g)


def units_from(t: pd.DataFrame, g: pd.DataFrame) -> dict[str, Unit]:
    out = {}
    for name, gg in g.groupby("model"):
        n, k = int(gg["state"].max()), int(gg.groupby("state").size().max())
        d = len(gg["mean"].iloc[0])
        logw, mean, var = np.full((n, k), LOG0), np.zeros((n, k, d)), np.ones((n, k, d))
        for s, rows in gg.sort_values(["state", "comp"]).groupby("state"):
            m = len(rows)
            logw[s - 1, :m] = rows["logw"]
            mean[s - 1, :m] = np.vstack(rows["mean"])
            var[s - 1, :m] = np.vstack(rows["var"])
        trans = np.full((n + 2, n + 2), LOG0)
        tt = t[t["model"] == name]
        trans[tt["i"].astype(int), tt["j"].astype(int)] = np.maximum(tt["logp"].astype(float), LOG0)
        out[str(name)] = Unit(str(name), trans, logw, mean, var)
    return out


def model_batches(transition: DataFrame, gaussian: DataFrame, rows: int = MODEL_ROWS) -> list[tuple[DataFrame, DataFrame]]:
    """Split large model sets into batches by name; results of the batches are united."""
    n = max(transition.count(), gaussian.count())
    parts = max(1, -(-n // rows))
    if parts == 1:
        return [(transition, gaussian)]
    key = F.pmod(F.xxhash64("model"), F.lit(2 * parts))
    return [(transition.filter(key == i), gaussian.filter(key == i)) for i in range(2 * parts)]


# -- recursions over a batch of pieces -----------------------------------------------


@dataclass
class Batch:
    """Pieces of equal chain, padded: emissions (groups, longest, states)."""

    emit: np.ndarray
    lens: np.ndarray
    begin: np.ndarray
    comps: list[np.ndarray]
    x: np.ndarray


def load_batch(pdf: pd.DataFrame, c: Chain) -> Batch:
    """Rows of whole pieces, sorted, to padded arrays."""
    key = pdf[["seq_id", "_piece"]]
    new = np.r_[True, (key.iloc[1:].to_numpy() != key.iloc[:-1].to_numpy()).any(axis=1)]
    begin = np.flatnonzero(new)
    lens = np.diff(np.r_[begin, len(pdf)])
    x = np.vstack(pdf["x"].to_numpy()).astype(float)
    by_name: dict[str, np.ndarray] = {}
    for u in c.units:
        if u.name not in by_name:
            by_name[u.name] = u.component_logs(x)
    comps = [by_name[u.name] for u in c.units]
    flat = np.concatenate([lse(v, 2) for v in comps], axis=1)
    emit = np.zeros((len(begin), int(lens.max()), flat.shape[1]))
    group = np.repeat(np.arange(len(begin)), lens)
    emit[group, np.arange(len(pdf)) - begin[group]] = flat
    return Batch(emit, lens, begin, comps, x)


def forward(b: Batch, c: Chain, start: np.ndarray, best: bool, trace: bool = False):
    """Scores after each frame from ``start`` (groups, states + 1)."""
    v, longest = start.copy(), b.emit.shape[1]
    all_v = np.full((len(start), longest, start.shape[1]), LOG0) if trace else None
    back = np.zeros((len(start), longest, start.shape[1]), dtype=np.int32) if trace and best else None
    for t in range(longest):
        live = b.lens > t
        s = v[live][:, :, None] + c.step[None]
        new = np.full((live.sum(), v.shape[1]), LOG0)
        if best:
            new[:, 1:] = s[:, :, 1:].max(axis=1) + b.emit[live, t]
            if back is not None:
                back[live, t] = s.argmax(axis=1)
        else:
            new[:, 1:] = lse(s[:, :, 1:], 1) + b.emit[live, t]
        v[live] = np.maximum(new, LOG0)
        if trace:
            all_v[live, t] = v[live]
    return v, all_v, back


def backward(b: Batch, c: Chain, end: np.ndarray) -> np.ndarray:
    """Sum scores of everything after each frame, given ``end`` after the piece."""
    longest = b.emit.shape[1]
    beta = np.full((len(end), longest, end.shape[1]), LOG0)
    for t in range(longest - 1, -1, -1):
        last = b.lens - 1 == t
        beta[last, t] = end[last]
        live = b.lens - 1 > t
        if live.any():
            ahead = beta[live, t + 1][:, 1:] + b.emit[live, t + 1]
            beta[live, t] = np.maximum(lse(c.step[None, :, 1:] + ahead[:, None, :], 2), LOG0)
    return beta


def piece_matrices(b: Batch, c: Chain, best: bool) -> np.ndarray:
    """(groups, s + 1, s + 1): effect of a piece for every entry state."""
    n, g = len(c.step), len(b.lens)
    out = np.empty((g, n, n))
    for i in range(n):
        start = np.full((g, n), LOG0)
        start[:, i] = 0.0
        out[:, i] = forward(b, c, start, best)[0]
    return out


def times(a: np.ndarray, m: np.ndarray, best: bool) -> np.ndarray:
    s = a[..., :, :, None] + m[..., None, :, :]
    return np.maximum(s.max(axis=-2) if best else lse(s, -2), LOG0)


def one_hot(i: int, n: int) -> np.ndarray:
    v = np.full(n, LOG0)
    v[i] = 0.0
    return v


# -- pieces in Spark -----------------------------------------------------------------


def _prepare(frames: DataFrame, key: str, piece: int) -> tuple[DataFrame, bool]:
    """Add ``_piece`` and the chain key ``_chain``; tell whether all sequences are short."""
    out = frames.withColumns({"_piece": F.floor(F.col("t") / piece), "_chain": F.col(key).cast("string")})
    long = len(frames.filter(F.col("t") >= piece).limit(1).take(1)) > 0
    return out, not long


def _by_chain(pdf: pd.DataFrame):
    for name, g in pdf.groupby("_chain", sort=False):
        yield name, g.reset_index(drop=True)


def _matrices(prepared: DataFrame, chains: Callable[[str], dict[str, Chain]], best: bool, seq_type: str) -> DataFrame:
    """``(seq_id, model, _piece, n, mat)`` for every model that the rows are scored on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, g in _by_chain(pdf):
            for model, c in chains(name).items():
                b = load_batch(g, c)
                mats = piece_matrices(b, c, best)
                head = g.iloc[b.begin]
                rows += list(zip(head["seq_id"], [model] * len(head), head["_piece"], b.lens, [m.ravel() for m in mats]))
        return pd.DataFrame(rows, columns=["seq_id", "model", "_piece", "n", "mat"])

    cols = prepared.select("seq_id", "_piece", "_chain", "t", "x")
    return map_whole_groups(cols, ["seq_id", "_piece"], ["t"], run, f"seq_id {seq_type}, model string, _piece long, n long, mat array<double>")


def _combine(level: DataFrame, best: bool, seq_type: str, fan: int) -> DataFrame:
    """Multiply the matrices of ``fan`` consecutive pieces."""
    grouped = level.withColumn("_up", F.floor(F.col("_piece") / fan))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (seq, model, up), g in pdf.groupby(["seq_id", "model", "_up"], sort=False):
            mats = [np.asarray(m, float) for m in g["mat"]]
            n = int(np.sqrt(len(mats[0])))
            total = mats[0].reshape(n, n)
            for m in mats[1:]:
                total = times(total, m.reshape(n, n), best)
            rows.append((seq, model, up, int(g["n"].sum()), total.ravel()))
        return pd.DataFrame(rows, columns=["seq_id", "model", "_piece", "n", "mat"])

    return map_whole_groups(grouped, ["seq_id", "model", "_up"], ["_piece"], run, f"seq_id {seq_type}, model string, _piece long, n long, mat array<double>")


def _levels(base: DataFrame, best: bool, seq_type: str, fan: int) -> list[DataFrame]:
    """Matrix tables from the pieces up to one matrix per sequence and model."""
    levels = [cut(base)]
    while (levels[-1].agg(F.max("_piece")).first()[0] or 0) > 0:
        levels.append(cut(_combine(levels[-1], best, seq_type, fan)))
    return levels


def _descend(levels: list[DataFrame], top: DataFrame, best: bool, seq_type: str, fan: int) -> DataFrame:
    """Entry and exit conditions of every piece: ``(seq_id, model, _piece, enter, leave)``.

    Best path: ``enter`` and ``leave`` are one-hot state vectors.  Sums: they are
    the score vectors before and after the piece.  ``closing`` marks the last piece.
    """
    known = top
    for level in reversed(levels[:-1]):
        parent = known.select("seq_id", "model", F.col("_piece").alias("_up"), "enter", "leave", "closing")
        joined = level.withColumn("_up", F.floor(F.col("_piece") / fan)).join(parent, ["seq_id", "model", "_up"])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for (seq, model, _), g in pdf.groupby(["seq_id", "model", "_up"], sort=False):
                mats = [np.asarray(m, float) for m in g["mat"]]
                n = int(np.sqrt(len(mats[0])))
                mats = [m.reshape(n, n) for m in mats]
                enter = [np.asarray(g["enter"].iloc[0], float)]
                for m in mats[:-1]:
                    enter.append(times(enter[-1][None], m, best)[0])
                leave = [np.asarray(g["leave"].iloc[0], float)]
                closing = [False] * (len(mats) - 1) + [bool(g["closing"].iloc[0])]
                if best:
                    out = int(np.argmax(leave[0]))
                    pairs = []
                    for v, m in zip(reversed(enter), reversed(mats)):
                        into = int(np.argmax(v + m[:, out]))
                        pairs.append((one_hot(into, n), one_hot(out, n)))
                        out = into
                    pairs.reverse()
                    rows += [(seq, model, p, a, z, e) for p, (a, z), e in zip(g["_piece"], pairs, closing)]
                else:
                    for m in reversed(mats[1:]):
                        leave.append(times(m, leave[-1][:, None], False)[:, 0])
                    leave.reverse()
                    rows += list(zip([seq] * len(mats), [model] * len(mats), g["_piece"], enter, leave, closing))
            return pd.DataFrame(rows, columns=["seq_id", "model", "_piece", "enter", "leave", "closing"])

        known = cut(map_whole_groups(joined, ["seq_id", "model", "_up"], ["_piece"], run, f"seq_id {seq_type}, model string, _piece long, enter array<double>, leave array<double>, closing boolean"))
    return known


def _top(level: DataFrame, chains: Callable[[str], dict[str, Chain]], best: bool, seq_type: str) -> DataFrame:
    """Total score of a whole sequence and its end conditions."""

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                c = chains(rec["model"])[rec["model"]]
                n = len(c.leave)
                end = np.asarray(rec["mat"], float).reshape(n, n)[0]
                out = end + c.leave
                total = float(out.max() if best else lse(out, 0))
                leave = one_hot(int(np.argmax(out)), n) if best else c.leave
                rows.append((rec["seq_id"], rec["model"], 0, rec["n"], max(total, LOG0), one_hot(0, n), leave, True))
            yield pd.DataFrame(rows, columns=["seq_id", "model", "_piece", "n", "total", "enter", "leave", "closing"])

    return level.mapInPandas(run, f"seq_id {seq_type}, model string, _piece long, n long, total double, enter array<double>, leave array<double>, closing boolean")


# -- best paths ----------------------------------------------------------------------


def viterbi_score(frames: DataFrame, transition: DataFrame, gaussian: DataFrame, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """Best-path score of every sequence on every model: ``(seq_id, model, n, total, score)``.

    ``score`` is the total divided by the frames, so sequences of different
    lengths compare; it is null when no path exists.
    """
    out = None
    for t, g in model_batches(transition, gaussian):
        units = collect_units(t, g)
        chains_of = {name: chain([u]) for name, u in units.items()}
        part = _score(frames, lambda _, c=chains_of: c, piece, fan)
        out = part if out is None else out.unionByName(part)
    return out


def _score(frames: DataFrame, chains: Callable[[str], dict[str, Chain]], piece: int, fan: int) -> DataFrame:
    seq_type = dict(frames.dtypes)["seq_id"]
    prepared, short = _prepare(frames.withColumn("_one", F.lit("")), "_one", piece)
    if short:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for model, c in chains("").items():
                b = load_batch(pdf, c)
                start = np.tile(one_hot(0, len(c.leave)), (len(b.lens), 1))
                end = forward(b, c, start, True)[0]
                total = np.maximum((end + c.leave).max(axis=1), LOG0)
                rows.append(pd.DataFrame({"seq_id": pdf["seq_id"].to_numpy()[b.begin], "model": model, "n": b.lens, "total": total}))
            return pd.concat(rows, ignore_index=True)

        flat = map_whole_groups(prepared.select("seq_id", "_piece", "t", "x"), ["seq_id"], ["t"], run, f"seq_id {seq_type}, model string, n long, total double")
    else:
        levels = _levels(_matrices(prepared, chains, True, seq_type), True, seq_type, fan)
        flat = _top(levels[-1], lambda m: chains(""), True, seq_type).select("seq_id", "model", "n", "total")
    ok = F.col("total") > LOG0 / 2
    return flat.select("seq_id", "model", "n", F.when(ok, F.col("total")).alias("total"), F.when(ok, F.col("total") / F.col("n")).alias("score"))


def viterbi_path(frames: DataFrame, transition: DataFrame, gaussian: DataFrame, model: str = "label", piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """Best state path of every sequence on its own model (column ``model``):
    the frames with ``state``; sequences without a path are left out."""
    units = collect_units(transition, gaussian)
    chains_of = {name: chain([u]) for name, u in units.items()}
    lookup = lambda name: {name: chains_of[name]} if name in chains_of else {}
    seq_type = dict(frames.dtypes)["seq_id"]
    prepared, short = _prepare(frames, model, piece)
    cols = prepared.select("seq_id", "_piece", "_chain", "t", "x")
    if not short:
        levels = _levels(_matrices(prepared, lookup, True, seq_type), True, seq_type, fan)
        top = _top(levels[-1], lookup, True, seq_type).filter(F.col("total") > LOG0 / 2)
        ends = _descend(levels, top.drop("total", "n"), True, seq_type, fan)
        cols = cols.join(ends.drop("model"), ["seq_id", "_piece"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, g in _by_chain(pdf):
            for c in lookup(name).values():
                b = load_batch(g, c)
                n = len(c.leave)
                if "enter" in g:
                    start, leave = np.vstack(g["enter"].to_numpy()[b.begin]), np.vstack(g["leave"].to_numpy()[b.begin])
                else:
                    start, leave = np.tile(one_hot(0, n), (len(b.lens), 1)), np.tile(c.leave, (len(b.lens), 1))
                end, _, back = forward(b, c, start, True, trace=True)
                final = end + leave
                state = final.argmax(axis=1)
                ok = final.max(axis=1) > LOG0 / 2
                path = np.zeros(b.emit.shape[:2], dtype=np.int32)
                for t in range(b.emit.shape[1] - 1, -1, -1):
                    live = b.lens > t
                    path[live, t] = state[live]
                    state = np.where(live, back[np.arange(len(state)), t, state], state)
                group = np.repeat(np.arange(len(b.lens)), b.lens)
                flat = path[group, np.arange(len(g)) - b.begin[group]]
                keep = ok[group]
                out.append(pd.DataFrame({"seq_id": g["seq_id"][keep], "t": g["t"][keep], "x": g["x"][keep], "_chain": name, "state": flat[keep]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("seq_id", "t", "x", "_chain", "state")})

    out = map_whole_groups(cols, ["seq_id", "_piece"], ["t"], run, f"seq_id {seq_type}, t long, x array<double>, _chain string, state int")
    return out.withColumnRenamed("_chain", model)


# -- blocks of short sequences -------------------------------------------------------

BLOCK_FRAMES = 32_768  # frames of one written row
CELLS = 1_048_576  # numbers of one step of a recursion


def sequence_blocks(frames: DataFrame, key: str, piece: int) -> DataFrame | None:
    """Sequences of less than ``piece`` frames, written once: ``(_chain, mixed, dims, lens, first, x)``; None if one is longer.

    A block holds sequences of one chain by falling length, all their first frames, then all second ones.  ``first`` marks the
    frames with t = 0; ``mixed`` tells that a sequence has frames of several chains, which are then sequences of their own.
    """
    prepared, short = _prepare(frames, key, piece)
    if not short:
        return None

    def packed(table: pa.Table) -> pa.RecordBatch:
        code = codes_of(table, ["_chain"])
        pieces = codes_of(table, ["seq_id", "_piece"])
        chains, t = table.column("_chain").to_pylist(), table.column("t").to_numpy()
        x = pa.concat_arrays(table.column("x").chunks).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        mixed = len(np.unique(pieces * (int(code.max()) + 1) + code)) > len(np.unique(pieces))
        rows = []
        for c in range(int(code.max()) + 1):
            at = np.flatnonzero(code == c)
            if chains[at[0]] is None:
                continue
            begin = np.flatnonzero(np.r_[True, np.diff(pieces[at]) != 0])
            lens = np.diff(np.r_[begin, len(at)])
            order = np.argsort(-lens, kind="stable")
            begin, lens = begin[order], lens[order]
            placed = at[np.concatenate([begin[: np.count_nonzero(lens > i)] + i for i in range(lens[0])])]
            rows.append((chains[at[0]], mixed, x.shape[1], lens.astype(np.int32).tobytes(), (t[placed] == 0).tobytes(), np.ascontiguousarray(x[placed].T, float).tobytes()))
        kinds = [pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_chain", "mixed", "dims", "lens", "first", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows < BLOCK_FRAMES:
                continue
            same = np.flatnonzero(np.diff(codes_of(held, ["seq_id", "_piece"])))
            if len(same):
                yield packed(held.slice(0, int(same[-1]) + 1))
                held = held.slice(int(same[-1]) + 1)
        if held is not None:
            yield packed(held)

    cols = prepared.select("seq_id", "_piece", "_chain", "t", F.col("x").cast("array<double>").alias("x"))
    placed = cols.repartition("seq_id", "_piece").sortWithinPartitions("seq_id", "_piece", "t")
    schema = "_chain string, mixed boolean, dims int, lens binary, first binary, x binary"
    path = fresh_path(frames.sparkSession, "sequences")
    placed.mapInArrow(run, schema).write.option("maxRecordsPerFile", FILE_CHUNKS).parquet(path)
    return frames.sparkSession.read.schema(schema).parquet(path)


@dataclass
class Packed:
    """A block: frame i of all sequences longer than i lies at ``at[i]``, ``live[i]`` of them."""

    lens: np.ndarray
    first: np.ndarray  # (frames,) t = 0
    x: np.ndarray  # (dims, frames)

    def __post_init__(self) -> None:
        self.live = np.array([np.count_nonzero(self.lens > i) for i in range(int(self.lens[0]))])
        self.at = np.r_[0, np.cumsum(self.live)]
        self.owner = np.concatenate([np.arange(m) for m in self.live])  # frame -> sequence
        self.last = self.at[self.lens - 1] + np.arange(len(self.lens))
        later = np.arange(self.live[0], len(self.owner))  # frames with a frame before them
        self.later, self.before = later, later - np.repeat(self.live[:-1], self.live[1:])


def packed_blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, Packed]]:
    for name, dims, lens, first, x in zip(batch.column("_chain").to_pylist(), batch.column("dims").to_pylist(), batch.column("lens"), batch.column("first"), batch.column("x")):
        yield name, Packed(np.frombuffer(lens.as_buffer(), np.int32), np.frombuffer(first.as_buffer(), bool), np.frombuffer(x.as_buffer(), float).reshape(dims, -1))


def _unit_logs(u: Unit, x: np.ndarray) -> np.ndarray:
    """``component_logs`` as (states, components, frames) of ``x`` (dims, frames)."""
    out = (u.logw - 0.5 * (np.log(u.var).sum(2) + len(x) * np.log(2 * np.pi)))[:, :, None]
    for i in range(len(x)):
        gap = x[i] - u.mean[:, :, i, None]
        out = out - gap * gap * (0.5 / u.var[:, :, i, None])
    return np.where(np.isnan(out), LOG0, np.maximum(out, LOG0))


def _onward(v: np.ndarray, step: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores (from, frames) through ``step`` (from, to): (to, frames), and the best states they come from."""
    n, width = len(step), max(1, CELLS // step.size)
    out = np.empty((step.shape[1], v.shape[1]))
    back = np.empty(out.shape, np.int32) if best else None
    for a in range(0, v.shape[1], width):
        s = v[:, None, a : a + width] + step[:, :, None]
        top = s.max(axis=0)
        if best:
            out[:, a : a + width], back[:, a : a + width] = top, s.argmax(axis=0)
        else:
            out[:, a : a + width] = top if n == 1 else top + np.log(np.exp(s - top).sum(axis=0))
    return out, back


def _packed_forward(b: Packed, c: Chain, emit: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of the emitting states after every frame (states, frames)."""
    out = np.empty_like(emit)
    back = np.zeros(emit.shape, np.int32) if best else None
    out[:, : b.live[0]] = np.maximum(c.step[0, 1:, None] + emit[:, : b.live[0]], LOG0)
    for m, a, z in zip(b.live[1:], b.at[:-1], b.at[1:]):
        v, from_ = _onward(out[:, a : a + m], c.step[1:, 1:], best)
        out[:, z : z + m] = np.maximum(v + emit[:, z : z + m], LOG0)
        if best:
            back[:, z : z + m] = from_
    return out, back


def _packed_emissions(b: Packed, c: Chain) -> tuple[list[np.ndarray], np.ndarray]:
    by_name = {u.name: _unit_logs(u, b.x) for u in {u.name: u for u in c.units}.values()}
    comps = [by_name[u.name] for u in c.units]
    return comps, np.concatenate([v[:, 0] if v.shape[1] == 1 else lse(v, 1) for v in comps])


def packed_statistics(b: Packed, c: Chain, name: str) -> list[tuple]:
    """``_batch_statistics`` of a block."""
    comps, emit = _packed_emissions(b, c)
    alpha, _ = _packed_forward(b, c, emit, False)
    step, leave = c.step[1:, 1:], c.leave[1:, None]
    beta = np.empty_like(alpha)
    for t in range(len(b.live) - 1, -1, -1):
        a, m, more = b.at[t], b.live[t], b.live[t + 1] if t + 1 < len(b.live) else 0
        beta[:, a + more : a + m] = leave
        if more:
            z = b.at[t + 1]
            beta[:, a : a + more] = np.maximum(_onward(beta[:, z : z + more] + emit[:, z : z + more], step.T, False)[0], LOG0)
    end = alpha[:, b.last] + leave
    total = lse(end, 0)
    ok = total > LOG0 / 2
    rows: list[tuple] = [("seq", name, 0, 0, float(ok.sum()), [float(total[ok].sum())], [0.0]), ("seq", name, 0, 1, float((~ok).sum()), [], [])]
    if not ok.any():
        return rows
    n = len(c.leave)
    xi = np.zeros((n, n))
    fine, total_of = ok[b.owner], total[b.owner]
    into = emit + beta - total_of
    heads = b.live[0]
    xi[0, 1:] = np.exp(np.minimum(c.step[0, 1:, None] + into[:, :heads], 0.0))[:, ok].sum(axis=1)
    keep = fine[b.later]
    later, before = b.later[keep], b.before[keep]
    for a in range(0, len(later), max(1, CELLS // step.size)):
        cur, prev = (v[a : a + max(1, CELLS // step.size)] for v in (later, before))
        s = alpha[:, None, prev] + step[:, :, None] + into[None, :, cur]
        xi[1:, 1:] += np.exp(np.minimum(s, 0.0)).sum(axis=2)
    gamma = np.where(fine, np.exp(np.minimum(alpha + beta - total_of, 0.0)), 0.0)
    final = np.r_[0.0, np.exp(np.minimum(end - total, 0.0))[:, ok].sum(axis=1)]
    x = np.where(np.isnan(b.x), 0.0, b.x).T  # a frame with a null makes its sequence impossible, so its weight is zero
    square = x * x
    at = 1
    for p, u in enumerate(c.units):
        rows += _transition_rows(c, xi, final, p, at)
        share = np.ones_like(comps[p]) if comps[p].shape[1] == 1 else np.exp(comps[p] - lse(comps[p], 1)[:, None])
        resp = share * gamma[at - 1 : at - 1 + u.size, None]
        rows += [
            ("gauss", u.name, s + 1, k, float(resp[s, k].sum()), (resp[s, k] @ x).tolist(), (resp[s, k] @ square).tolist())
            for s in range(u.size) for k in range(resp.shape[1]) if u.logw[s, k] > LOG0 / 2
        ]
        at += u.size
    return rows


def _summed_in_task(blocks: DataFrame, lookup: Callable[[str], dict[str, Chain]], of_block: Callable[[Packed, Chain, str], list[tuple]]) -> DataFrame:
    """Statistics of all blocks; a task adds up its own, one row per cell of the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for name, b in packed_blocks(batch):
                for c in lookup(name).values():
                    for kind, model, i, j, occ, s1, s2 in of_block(b, c, name):
                        old = held.get((kind, model, i, j))
                        now = [occ, np.array(s1, float), np.array(s2, float)]
                        held[kind, model, i, j] = now if old is None else [p + q for p, q in zip(old, now)]
        cols = list(zip(*[(*k, *v) for k, v in held.items()])) if held else [[]] * 7
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["kind", "model", "a", "b", "occ", "s1", "s2"])

    return _summed(cut(blocks.mapInArrow(run, STAT_SCHEMA)))  # two sums read one pass


def _summed(parts: DataFrame) -> DataFrame:
    heads = parts.groupBy("kind", "model", "a", "b").agg(F.sum("occ").alias("occ"))
    dims = parts.filter(F.size("s1") > 0).select("kind", "model", "a", "b", F.posexplode(F.arrays_zip("s1", "s2")).alias("d", "z"))
    sums = dims.groupBy("kind", "model", "a", "b", "d").agg(F.sum("z.s1").alias("s1"), F.sum("z.s2").alias("s2"))
    packed = sums.groupBy("kind", "model", "a", "b").agg(F.array_sort(F.collect_list(F.struct("d", "s1", "s2"))).alias("z"))
    out = heads.join(packed, ["kind", "model", "a", "b"], "left")
    return out.select("kind", "model", "a", "b", "occ", F.transform("z", lambda e: e["s1"]).alias("s1"), F.transform("z", lambda e: e["s2"]).alias("s2"))


def packed_paths(b: Packed, c: Chain, name: str, k: int) -> list[tuple]:
    """Best paths of a block as sums: scores (``seq``), moves (``trans``), and by state frames (``count``) and values (``gauss``).

    Values are sums of the gaps to the state's present mean and of their squares, and (``held``) how many are not null.
    """
    _, emit = _packed_emissions(b, c)
    v, back = _packed_forward(b, c, emit, True)
    end = v[:, b.last] + c.leave[1:, None]
    total = np.maximum(end.max(axis=0), LOG0)
    ok = total > LOG0 / 2
    rows: list[tuple] = [("seq", name, 0, 0, float(ok.sum()), [float((total[ok] / b.lens[ok]).sum())], [0.0])]
    path, now, final = np.empty(emit.shape[1], np.int64), np.empty(len(b.lens), np.int64), end.argmax(axis=0)
    for t in range(len(b.live) - 1, -1, -1):
        a, m, more = b.at[t], b.live[t], b.live[t + 1] if t + 1 < len(b.live) else 0
        now[more:m] = final[more:m]
        path[a : a + m] = now[:m]
        if t:
            now[:m] = back[now[:m], a + np.arange(m)]
    path += 1
    fine = ok[b.owner]
    moves = np.zeros((k + 2, k + 2))
    np.add.at(moves[0], path[fine & b.first], 1)
    keep = fine[b.later]
    np.add.at(moves, (path[b.before[keep]], path[b.later[keep]]), 1)
    np.add.at(moves[:, k + 1], path[b.last[ok]], 1)
    rows += [("trans", name, int(i), int(j), float(moves[i, j]), [], []) for i, j in zip(*np.nonzero(moves))]
    for s in range(1, len(c.leave)):
        x = b.x[:, fine & (path == s)]
        if x.shape[1]:
            gap = x - c.units[0].mean[s - 1, 0][:, None]
            there = ~np.isnan(gap)
            gap = np.where(there, gap, 0.0)
            rows.append(("gauss", name, s, 0, float(x.shape[1]), gap.sum(axis=1).tolist(), (gap * gap).sum(axis=1).tolist()))
            rows.append(("held", name, s, 0, 0.0, there.sum(axis=1).astype(float).tolist(), [0.0] * len(x)))
    return rows


def models_from_sums(stats: DataFrame, gaussian: DataFrame, kind: str, floor: float = VAR_FLOOR) -> tuple[DataFrame, DataFrame]:
    """``models_from_paths`` of the sums of ``packed_paths`` on the models ``gaussian`` of one component."""
    from pyspark.sql.window import Window

    name = F.col("model").cast(kind).alias("model")
    t = stats.filter("kind = 'trans'")
    share = F.col("occ") / F.sum("occ").over(Window.partitionBy("model", "a"))
    transition = t.select(name, F.col("a").alias("i"), F.col("b").alias("j"), F.log(share).alias("logp"))
    sums = stats.filter("kind = 'gauss'").select("model", F.col("a").alias("state"), "s1", "s2")
    held = stats.filter("kind = 'held'").select("model", F.col("a").alias("state"), F.col("s1").alias("n"))
    old = gaussian.select(F.col("model").cast("string").alias("model"), "state", F.col("mean").alias("m"))
    z = sums.join(held, ["model", "state"]).join(old, ["model", "state"]).withColumn("z", F.arrays_zip("n", "s1", "s2", "m"))
    mean = F.transform("z", lambda e: F.when(e["n"] > 0, e["m"] + e["s1"] / e["n"]))
    var = F.transform("z", lambda e: F.greatest(F.when(e["n"] > 0, e["s2"] / e["n"] - (e["s1"] / e["n"]) * (e["s1"] / e["n"])), F.lit(floor)))
    return transition, z.select(name, "state", F.lit(0).alias("comp"), F.lit(0.0).alias("logw"), mean.alias("mean"), var.alias("var"))


# -- Baum-Welch ----------------------------------------------------------------------


def _pieces_for_sums(frames: DataFrame, key: str, lookup: Callable[[str], dict[str, Chain]], piece: int, fan: int) -> DataFrame:
    seq_type = dict(frames.dtypes)["seq_id"]
    prepared, short = _prepare(frames, key, piece)
    cols = prepared.select("seq_id", "_piece", "_chain", "t", "x")
    if short:
        return cols
    levels = _levels(_matrices(prepared, lookup, False, seq_type), False, seq_type, fan)
    top = _top(levels[-1], lookup, False, seq_type)  # impossible sequences stay: they are counted as skipped
    ends = _descend(levels, top.drop("total", "n"), False, seq_type, fan)
    return cols.join(ends.drop("model"), ["seq_id", "_piece"])


STAT_SCHEMA = "kind string, model string, a int, b int, occ double, s1 array<double>, s2 array<double>"


def sequence_statistics(frames: DataFrame, lookup: Callable[[str], dict[str, Chain]], key: str, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """Summed forward-backward statistics.

    ``kind`` is ``trans`` (model, i, j, occ), ``gauss`` (model, state, comp, occ,
    s1, s2) or ``seq`` (model, 0, 0, log-likelihood in s1, number in occ, skipped
    in b).  Every batch adds up its pieces before anything is shuffled.
    """
    cols = _pieces_for_sums(frames, key, lookup, piece, fan)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for name, g in _by_chain(pdf):
            for c in lookup(name).values():
                rows += _batch_statistics(g, c, name)
        return pd.DataFrame(rows, columns=["kind", "model", "a", "b", "occ", "s1", "s2"])

    return _summed(cut(map_whole_groups(cols, ["seq_id", "_piece"], ["t"], run, STAT_SCHEMA)))  # two sums read one pass


def _batch_statistics(g: pd.DataFrame, c: Chain, name: str) -> list[tuple]:
    b = load_batch(g, c)
    n = len(c.leave)
    first = (g["_piece"].to_numpy()[b.begin] == 0)
    if "enter" in g:
        start, end = np.vstack(g["enter"].to_numpy()[b.begin]), np.vstack(g["leave"].to_numpy()[b.begin])
    else:
        start, end = np.tile(one_hot(0, n), (len(b.lens), 1)), np.tile(c.leave, (len(b.lens), 1))
    last, alpha, _ = forward(b, c, start, False, trace=True)
    beta = backward(b, c, end)
    total = lse(last + end, 1)
    ok = total > LOG0 / 2
    rows: list[tuple] = [("seq", name, 0, 0, float((ok & first).sum()), [float(total[ok & first].sum())], [0.0])]
    rows.append(("seq", name, 0, 1, float((~ok & first).sum()), [], []))
    if not ok.any():
        return rows
    # transitions: from the score before a frame into its state
    xi = np.zeros((n, n))
    for t in range(b.emit.shape[1]):
        live = ok & (b.lens > t)
        if not live.any():
            break
        before = start[live] if t == 0 else alpha[live, t - 1]
        into = b.emit[live, t] + beta[live, t][:, 1:]
        s = before[:, :, None] + c.step[None, :, 1:] + into[:, None, :] - total[live][:, None, None]
        xi[:, 1:] += np.exp(np.minimum(s, 0.0)).sum(axis=0)
    group = np.repeat(np.arange(len(b.lens)), b.lens)
    at = np.arange(len(g)) - b.begin[group]
    gamma = np.where(ok[group][:, None], np.exp(np.minimum(alpha[group, at] + beta[group, at] - total[group][:, None], 0.0)), 0.0)[:, 1:]
    # the exit transition belongs to the last piece of a sequence
    closing = ok & g["closing"].to_numpy(bool)[b.begin] if "closing" in g else ok
    final = np.exp(np.minimum(last + end - total[:, None], 0.0))[closing].sum(axis=0)
    rows += _unit_rows(c, xi, final, gamma, b)
    return rows


def _unit_rows(c: Chain, xi: np.ndarray, final: np.ndarray, gamma: np.ndarray, b: Batch) -> list[tuple]:
    """Statistics of a chain charged to its units (shared units add up)."""
    rows: list[tuple] = []
    at = 1
    for p, u in enumerate(c.units):
        n = u.size
        rows += _transition_rows(c, xi, final, p, at)
        logs = b.comps[p]
        share = np.exp(logs - lse(logs, 2)[:, :, None])
        resp = share * gamma[:, at - 1 : at - 1 + n, None]
        for s in range(n):
            for k in range(resp.shape[2]):
                if u.logw[s, k] > LOG0 / 2:
                    r = resp[:, s, k]
                    rows.append(("gauss", u.name, s + 1, k, float(r.sum()), (r @ b.x).tolist(), (r @ (b.x * b.x)).tolist()))
        at += n
    return rows


def _transition_rows(c: Chain, xi: np.ndarray, final: np.ndarray, p: int, at: int) -> list[tuple]:
    """Transitions of the unit at position ``p`` of a chain, whose first state is ``at``."""
    u = c.units[p]
    n = u.size
    inner = xi[at : at + n, at : at + n]
    enter = xi[0, at : at + n] if p == 0 else xi[at - c.units[p - 1].size : at, at : at + n].sum(axis=0)
    if p == len(c.units) - 1:
        out = final[at : at + n]
    else:
        out = xi[at : at + n, at + n : at + n + c.units[p + 1].size].sum(axis=1)
    rows: list[tuple] = [("trans", u.name, 0, j + 1, float(enter[j]), [], []) for j in range(n) if enter[j] > 0]
    rows += [("trans", u.name, i + 1, n + 1, float(out[i]), [], []) for i in range(n) if out[i] > 0]
    rows += [("trans", u.name, i + 1, j + 1, float(inner[i, j]), [], []) for i in range(n) for j in range(n) if inner[i, j] > 0]
    return rows


def reestimate(stats: DataFrame, gaussian: DataFrame, floor: float = VAR_FLOOR, weight_floor: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Statistics to new tables; a component or state without visits keeps its values."""
    from pyspark.sql.window import Window

    t = stats.filter("kind = 'trans'")
    trans = t.select("model", F.col("a").alias("i"), F.col("b").alias("j"), F.log(F.col("occ") / F.sum("occ").over(Window.partitionBy("model", "a"))).alias("logp"))
    g = stats.filter("kind = 'gauss'").select(F.col("model"), F.col("a").alias("state"), F.col("b").alias("comp"), "occ", "s1", "s2")
    old = gaussian.select("model", "state", "comp", F.col("logw").alias("_w"), F.col("mean").alias("_m"), F.col("var").alias("_v"))
    j = old.join(g, ["model", "state", "comp"], "left")
    occ = F.col("occ")
    live = F.coalesce(occ, F.lit(0.0)) > 1e-8
    j = j.withColumn("mean", F.when(live, F.transform("s1", lambda v: v / occ)).otherwise(F.col("_m")))
    j = j.withColumn("var", F.when(live, F.zip_with("s2", "mean", lambda q, m: F.greatest(q / occ - m * m, F.lit(floor)))).otherwise(F.col("_v")))
    all_occ = F.sum(F.coalesce(occ, F.lit(0.0))).over(Window.partitionBy("model", "state"))
    share = F.greatest(F.coalesce(occ, F.lit(0.0)) / all_occ, F.lit(weight_floor))
    j = j.withColumn("logw", F.when(all_occ > 1e-8, F.log(share)).otherwise(F.col("_w")))
    return trans, j.select("model", "state", "comp", "logw", "mean", "var")


def _own_chain(transition: DataFrame, gaussian: DataFrame) -> Callable[[str], dict[str, Chain]]:
    chains_of = {n: chain([u]) for n, u in collect_units(transition, gaussian).items()}
    return lambda name: {name: chains_of[name]} if name in chains_of else {}


def baum_welch_step(frames: DataFrame, transition: DataFrame, gaussian: DataFrame, model: str = "label", floor: float = VAR_FLOOR, piece: int = PIECE, fan: int = FAN, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One re-estimation of all models: (transition, gaussian, statistics); ``blocks`` are the frames' blocks if the caller has them.

    Rows are trained on the model named by their ``model`` column, so all labels
    share one job.  The statistics are written out, which cuts the lineage.
    """
    own = _own_chain(transition, gaussian)
    stats = cut(sequence_statistics(frames, own, model, piece, fan) if blocks is None else _summed_in_task(blocks, own, packed_statistics))
    return (*reestimate(stats, gaussian, floor), stats)


def mean_loglik(stats: DataFrame) -> tuple[float, int, int]:
    """Mean log-likelihood per sequence, sequences used, sequences skipped."""
    row = stats.filter("kind = 'seq'").agg(
        F.sum(F.when(F.col("b") == 0, F.col("s1")[0])), F.sum(F.when(F.col("b") == 0, F.col("occ"))), F.sum(F.when(F.col("b") == 1, F.col("occ")))
    ).first()
    used = int(row[1] or 0)
    return (row[0] / used if used else float("-inf")), used, int(row[2] or 0)


def baum_welch_fit(frames: DataFrame, transition: DataFrame, gaussian: DataFrame, model: str = "label", max_iter: int = 20, tol: float = 1e-4, floor: float = VAR_FLOOR, piece: int = PIECE, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """Iterate until the mean log-likelihood per sequence moves less than ``tol``.  Short sequences are packed once."""
    trace: list[float] = []
    blocks = sequence_blocks(frames, model, piece) if blocks is None else blocks
    for _ in range(max_iter):
        transition, gaussian, stats = baum_welch_step(frames, transition, gaussian, model, floor, piece, blocks=blocks)
        transition, gaussian = cut(transition), cut(gaussian)
        trace.append(mean_loglik(stats)[0])
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol:
            break
    return transition, gaussian, trace


def grow_mixtures(frames: DataFrame, transition: DataFrame, gaussian: DataFrame, n: int, model: str = "label", max_iter: int = 20, floor: float = VAR_FLOOR) -> tuple[DataFrame, DataFrame]:
    """Split the heaviest component of every state and refit, up to ``n`` components."""
    have = gaussian.groupBy("model", "state").count().agg(F.max("count")).first()[0]
    blocks = sequence_blocks(frames, model, PIECE) if n > have else None
    for _ in range(n - have):
        heavy = gaussian.withColumn("weight", F.exp("logw"))
        split = split_heaviest(heavy.select("model", "state", "comp", "weight", "mean", "var"), ["model", "state"])
        gaussian = cut(split.select("model", "state", "comp", F.log(F.greatest("weight", F.lit(1e-30))).alias("logw"), "mean", "var"))
        transition, gaussian, _ = baum_welch_fit(frames, transition, gaussian, model, max_iter, floor=floor, blocks=blocks)
    return transition, gaussian


def occupation_stats(stats: DataFrame) -> DataFrame:
    """Examples per model (entries) and occupancy per state: ``(model, state, examples, occupancy)``."""
    examples = stats.filter("kind = 'trans' AND a = 0").groupBy("model").agg(F.sum("occ").alias("examples"))
    per_state = stats.filter("kind = 'gauss'").groupBy("model", F.col("a").alias("state")).agg(F.sum("occ").alias("occupancy"))
    return per_state.join(examples, "model")


# -- initial models --------------------------------------------------------------------


def initial_models(frames: DataFrame, k: int, dims: int, model: str = "label", floor: float = VAR_FLOOR) -> tuple[DataFrame, DataFrame]:
    """Uniform segmentation to single-Gaussian states and counted transitions."""
    return models_from_paths(cut(uniform_segmentation(frames, k)), k, dims, model, floor)


def models_from_paths(paths: DataFrame, k: int, dims: int, model: str = "label", floor: float = VAR_FLOOR) -> tuple[DataFrame, DataFrame]:
    t = transition_counts(paths, k, model)
    transition = t.select("model", "i", "j", F.log("p").alias("logp"))
    m = state_moments(paths.withColumn("comp", F.lit(0)), dims, [model, "state", "comp"], floor)
    gaussian = m.select(F.col(model).alias("model"), "state", "comp", F.log("weight").alias("logw"), "mean", "var")
    return transition, gaussian


def segmental_kmeans(frames: DataFrame, k: int, dims: int, model: str = "label", max_iter: int | None = None, tol: float = 1e-3, floor: float = VAR_FLOOR, piece: int = PIECE) -> tuple[DataFrame, DataFrame, list[float]]:
    """Uniform segmentation, then realign on best paths until the mean score settles."""
    frames = cut(frames.select("seq_id", "t", "x", model))
    transition, gaussian = (cut(t) for t in initial_models(frames, k, dims, model, floor))
    trace: list[float] = []
    blocks = sequence_blocks(frames, model, piece)
    if blocks is not None and not blocks.filter("mixed").take(1):
        return _segmental_blocks(blocks, transition, gaussian, k, dict(frames.dtypes)[model], max_iter, tol, floor)
    while max_iter is None or len(trace) < max_iter:
        scores = viterbi_score(frames, transition, gaussian, piece)
        own = frames.select("seq_id", F.col(model).alias("model")).distinct()
        now = scores.join(own, ["seq_id", "model"]).agg(F.avg("score")).first()[0]
        if now is None:
            break
        trace.append(float(now))
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol:
            break
        paths = viterbi_path(frames, transition, gaussian, model, piece)
        transition, gaussian = (cut(t) for t in models_from_paths(paths, k, dims, model, floor))
    return transition, gaussian, trace


def _segmental_blocks(blocks: DataFrame, transition: DataFrame, gaussian: DataFrame, k: int, kind: str, max_iter: int | None, tol: float, floor: float) -> tuple[DataFrame, DataFrame, list[float]]:
    """The rounds of ``segmental_kmeans`` over blocks: one pass scores and aligns the sequences on their own models."""
    trace: list[float] = []
    while max_iter is None or len(trace) < max_iter:
        stats = cut(_summed_in_task(blocks, _own_chain(transition, gaussian), lambda b, c, name: packed_paths(b, c, name, k)))
        now, used, _ = mean_loglik(stats)
        if not used:
            break
        trace.append(now)
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol:
            break
        transition, gaussian = (cut(t) for t in models_from_sums(stats, gaussian, kind, floor))
    return transition, gaussian, trace


def single_state_models(frames: DataFrame, dims: int, model: str = "label", floor: float = VAR_FLOOR) -> tuple[DataFrame, DataFrame]:
    """Flat start: one state per label, stay and leave equally likely."""
    m = class_mean_var(frames, dims, [model], floor)
    gaussian = m.select(F.col(model).alias("model"), F.lit(1).alias("state"), F.lit(0).alias("comp"), F.lit(0.0).alias("logw"), "mean", "var")
    arcs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(p).alias("logp")) for i, j, p in ((0, 1, 0.0), (1, 1, float(np.log(0.5))), (1, 2, float(np.log(0.5))))])
    return gaussian.select("model", F.explode(arcs).alias("z")).select("model", "z.*"), gaussian


# -- classification --------------------------------------------------------------------


def classify_sequences(frames: DataFrame, transition: DataFrame, gaussian: DataFrame, min_len: int = 1, piece: int = PIECE) -> DataFrame:
    """Score sequences of at least ``min_len`` frames on all models: ``(seq_id, actual, predicted, score)``."""
    from strandlab.operators.series import min_frames

    kept = min_frames(frames, min_len)
    best = best_model(viterbi_score(kept, transition, gaussian, piece))
    actual = kept.filter(F.col("t") == 0).select("seq_id", F.col("label").alias("actual"))
    return best.join(actual, "seq_id")


# -- embedded training -------------------------------------------------------------------

SEP = "\u0001"


def embedded_step(frames: DataFrame, transcripts: DataFrame, transition: DataFrame, gaussian: DataFrame, tying: DataFrame | None = None, floor: float = VAR_FLOOR, piece: int = PIECE, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One re-estimation where a sequence is a chain of labels.

    ``transcripts(seq_id, pos, label)`` gives the labels in order and ``tying(label,
    model)`` maps logical to physical models, whose statistics are pooled.  Sequences
    without a transcript, or with a null or unknown label in it, count as skipped.
    """
    t = transcripts
    if tying is not None:
        t = t.join(tying, "label", "left").withColumn("label", F.coalesce("model", "label"))
    lists = t.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("z"))
    units = collect_units(transition, gaussian)
    labels = F.transform("z", lambda e: F.coalesce(e["label"], F.lit("")))
    known = F.forall(labels, lambda x: x.isin(list(units)))
    lists = cut(lists.select("seq_id", F.when(known, F.array_join(labels, SEP)).alias("_units")))
    cache: dict[str, Chain] = {}

    def lookup(name: str) -> dict[str, Chain]:
        names = name.split(SEP)
        if any(n not in units for n in names):
            return {}
        if name not in cache:
            if len(cache) > 1_000:
                cache.clear()
            cache[name] = chain([units[n] for n in names])
        return {name: cache[name]}

    usable = lists.filter(F.col("_units").isNotNull())
    lens = cut(frames.groupBy("seq_id").agg(F.count(F.lit(1)).alias("_len")))
    lost = lens.join(usable, "seq_id", "left_anti").count()
    none = F.array().cast("array<double>")
    skipped = frames.sparkSession.range(1).select(F.lit("seq").alias("kind"), F.lit("").alias("model"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(float(lost)).alias("occ"), none.alias("s1"), none.alias("s2"))
    named = join_sized(frames, usable.join(lens, "seq_id"), ["seq_id"], "_len", ["t"]).drop("_len")
    stats = cut(sequence_statistics(named, lookup, "_units", piece, fan).unionByName(skipped))
    return (*reestimate(stats, gaussian, floor), stats)


def sequence_matrices(frames: DataFrame, chains_of: dict[str, Chain], piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """One best-path matrix per (sequence, model) for incremental scoring: ``(seq_id, model, n, mat)``."""
    seq_type = dict(frames.dtypes)["seq_id"]
    prepared, _ = _prepare(frames.withColumn("_one", F.lit("")), "_one", piece)
    levels = _levels(_matrices(prepared, lambda _: chains_of, True, seq_type), True, seq_type, fan)
    return levels[-1].select("seq_id", "model", "n", "mat")
