"""N-gram Jaccard join by blocked sparse products of the document x shingle incidence matrix.

Documents with equal shingle sets are one class, so copies never meet.  Of each class only the first columns of its
row take part, in one global order with frequent shingles last, the most frequent at the end: as many as leave a similar
pair a good part of its overlap there.  Their overlap counts are accumulated, and pairs whose counts are below the bound that the two sizes give are
discarded before any text moves.  A column of many classes is not multiplied out: its classes are first compared with one of them, and after
the links found have joined them, only classes of different components of such columns meet, block by block, where the
overlap counts of a block are summed in one task.  The likeliest pairs of each class are checked first, so that classes of
one component by then need no further check.  All other pairs are checked on the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.components import components
from strandlab.llm.shared import as_text, lookup, slices, unused
from strandlab.llm.shingles import shingle_sets
from strandlab.session import cut, drop, scratch

#: Expected documents of the sample that orders columns, or the part of all documents if that is more (else ever more columns
#: beyond ``SMALL`` would be unknown), times a frequent shingle occurs in it, most shingles so marked, and the binary logarithm of
#: the times from which its column is dealt to many tasks.
#: They order and deal columns only; any order gives the same links.
SAMPLE_ROWS, SAMPLE_PART, FREQUENT, MARKED, DEALT = 20_000, 0.08, 2, 300_000, 3
#: Classes of a column that are multiplied out at once, classes of a block on either side, bytes of text at once.
SMALL, LEFT, RIGHT, CHUNK = 32, 4096, 8192, 1_000_000
#: Pairs of a class and a block of large columns that are checked first, and overlaps of a block that are counted at once.
BEST, COUNTED = 8, 1_000_000
#: Copies of classes that are dealt to blocks at once; they grow with the square of the classes, so larger work goes in turns.
COPIES = 20_000_000
#: A set has one first column more for each this many of its shingles than a single shared one would need.
EXTRA = 20


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that are frequent in a sample of about ``SAMPLE_ROWS`` rows or more, and the binary logarithm
    of how often each occurs there; the rarest logarithms are left out until at most ``MARKED`` shingles are left."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                value, n = np.unique(shingle_sets(column.slice(a, b - a), width)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["h", "n"])

    rows = docs.count()
    part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003)) < min(1.0, max(SAMPLE_PART, SAMPLE_ROWS / max(1, rows))) * 1_000_003)
    found = part.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    found = cut(found.select("h", F.floor(F.log2("n")).cast("int").alias("level")))
    least, marked = 64, 0
    for r in sorted(found.groupBy("level").count().collect(), reverse=True):  # at most 63 rows
        marked += r["count"]
        if marked > MARKED:
            break
        least = r["level"]
    kept = found.filter(F.col("level") >= least).toArrow()
    drop(found)
    value, level = kept.column("h").to_numpy().astype(np.int64).view(np.uint64), kept.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(value)
    return value[order], level[order]


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """First columns of sets of ``n`` shingles: all but the ``num/den`` that a similar set must share, one, and ``n / EXTRA``."""
    return np.minimum(n, n + 1 - -(-num * n // den) + n // EXTRA)


def least_shared(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """First columns that two similar sets of ``x`` and ``y`` shingles share at least.

    The shared shingles are at least ``num/(num + den)`` of both sizes.  In the global order, those in either set's first
    columns are the first of them, and at most what lies after the first columns of one set is missing there.
    """
    return -(-num * (x + y) // (num + den)) - np.maximum(x - prefix_size(x, num, den), y - prefix_size(y, num, den))


def _levels(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The logarithm of how often each shingle occurs in the sample; 0 if it is not marked."""
    marked, level = frequent
    if not len(marked):
        return np.zeros(len(values), dtype=np.uint8)
    at = np.minimum(np.searchsorted(marked, values), len(marked) - 1)
    return np.where(marked[at] == values, level[at], np.uint8(0))


def _first_columns(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """The first columns of a set, frequent ones last."""
    own = own[np.argsort(_levels(own, frequent), kind="stable")]
    return own[: int(prefix_size(np.int64(len(own)), num, den))]


def incidence(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, node, columns) of each row: size of its set, the class of equal sets (null if empty), first columns."""
    marked = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MARKED numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_text(batch.column("text"))
            for a, b in slices(column, CHUNK):
                offsets, flat = shingle_sets(column.slice(a, b - a), width)
                sets = [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
                first = [_first_columns(s, marked.value, num, den).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets)), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(first, pa.binary())], names=["doc_id", "n", "node", "columns"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, node long, columns binary")


def node_of(own: np.ndarray) -> int | None:
    """A number for a set; two different sets share it with probability 2**-64."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if len(own) else None


#: An entry of the incidence matrix: column, row, and the row's size (its complement if the column is dealt to many tasks).
CELL = "column long, node long, size long"
GATHERED = "a long, b long, column long, x long, y long, shared long"


def cells(entries: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The first columns of classes (node, n, columns) as entries; those of very frequent columns are dealt to many tasks."""
    marked = entries.sparkSession.sparkContext.broadcast(tuple(x[frequent[1] >= DEALT] for x in frequent))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("columns").to_pylist()
            count = np.array([len(p) // 8 for p in packed], dtype=np.int64)
            key = np.frombuffer(b"".join(packed), dtype=np.int64)
            hot = _levels(key.view(np.uint64), marked.value) > 0
            node, n = (np.repeat(np.asarray(batch.column(c), dtype=np.int64), count) for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, np.where(hot, ~n, n))], names=["column", "node", "size"])

    return entries.mapInArrow(spread, CELL)


def column_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, b, column, x, y, shared): pairs of classes with their sizes and how many of a task's small columns they share
    (column null), and the entries of dealt or large columns (b null).  Pairs whose sizes are too far apart are left
    out.  A column's entries are read in order and held only up to ``SMALL``."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, large = np.zeros((0, 3), dtype=np.int64), None
        for batch in batches:
            column, node, size = (np.asarray(batch.column(c), dtype=np.int64) for c in ("column", "node", "size"))
            hot = size < 0
            table = np.column_stack([column, node, np.where(hot, ~size, size)])
            away = hot | (table[:, 0] == large) if large is not None else hot
            yield from single(table[away])
            table = np.concatenate([rest, table[~away]])
            if not len(table):
                continue
            last = int(np.searchsorted(table[:, 0], table[-1, 0]))
            yield from group(table[:last])
            rest, large = table[last:], None
            if len(rest) > SMALL:
                large = int(rest[0, 0])
                yield from single(rest)
                rest = rest[:0]
        yield from group(rest)

    def group(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        begin = np.flatnonzero(np.diff(table[:, 0], prepend=~table[0, 0]))
        size = np.diff(begin, append=len(table))
        yield from single(table[np.repeat(size > SMALL, size)])
        held, rows = [], 0
        for k in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
            starts, (i, j) = begin[size == k], np.triu_indices(k, 1)
            many = max(1, 200_000 // len(i))
            for s in range(0, len(starts), many):
                at = starts[s : s + many, None]
                x, y = table[(at + i).ravel(), 1:], table[(at + j).ravel(), 1:]
                fits = (den * np.minimum(x[:, 1], y[:, 1]) >= num * np.maximum(x[:, 1], y[:, 1])) & (x[:, 0] != y[:, 0])
                x, y = x[fits], y[fits]
                turned = (x[:, 0] > y[:, 0])[:, None]
                held.append(np.hstack([np.where(turned, y, x), np.where(turned, x, y)]))
                rows += len(x)
                if rows > 400_000:
                    yield from counted(held)
                    held, rows = [], 0
        yield from counted(held)

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate(held) if held else np.zeros((0, 4), dtype=np.int64)
        if len(table):
            table = table[np.lexsort((table[:, 2], table[:, 0]))]
            first = np.flatnonzero(np.any(np.diff(table[:, [0, 2]], axis=0, prepend=~table[:1, [0, 2]]), axis=1))
            a, x, b, y = table[first].T
            yield made(a, b, None, x, y, np.diff(first, append=len(table)))

    def single(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(table):
            yield made(table[:, 1], None, table[:, 0], table[:, 2], None, None)

    def made(a, *rest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), *(pa.nulls(len(a), pa.int64()) if v is None else pa.array(v) for v in rest)], names=[c.split()[0] for c in GATHERED.split(", ")])

    deal = F.when(F.col("size") < 0, F.col("node").bitwiseAND(1023)).otherwise(-1)
    return entries.repartition("column", deal).sortWithinPartitions("column").mapInArrow(multiply, GATHERED)


def enough_shared(pairs: DataFrame, large: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose counts over all small columns reach what a similar pair must share.

    ``large`` (node, columns) counts a class's large first columns: a pair may share as many of them as both have.
    """
    total = pairs.groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum("shared").alias("shared"))
    first = lambda n: F.least(F.col(n), F.col(n) + 1 - F.ceil(F.col(n) * num / den) + F.floor(F.col(n) / EXTRA))
    overlap = F.ceil((F.col("x") + F.col("y")) * num / (num + den))
    least = overlap - F.greatest(F.col("x") - first("x"), F.col("y") - first("y"))
    side = lambda n: large.select(F.col("node").alias(n), F.col("columns").alias(f"_{n}"))
    named = total.withColumn("least", least).join(side("a"), "a", "left").join(side("b"), "b", "left")
    return named.filter(F.col("shared") >= F.col("least") - F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))).select("a", "b")


def _own_texts(named: DataFrame, width: int) -> DataFrame:
    """The rows (node, text) whose text is of that class: one id may stand for several texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, nodes = as_text(batch.column("text")), batch.column("node").to_pylist()
            for a, b in slices(column, CHUNK):
                offsets, flat = shingle_sets(column.slice(a, b - a), width)
                same = [node_of(flat[i:j]) == n for i, j, n in zip(offsets[:-1], offsets[1:], nodes[a:b])]
                yield batch.slice(a, b - a).filter(pa.array(same))

    return named.mapInArrow(check, "node long, text string")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = as_text(batch.column("text")), as_text(batch.column("other"))
            for a, b in slices(left, CHUNK // 2):
                (p, x), (q, y) = shingle_sets(left.slice(a, b - a), width), shingle_sets(right.slice(a, b - a), width)
                shared = np.array([len(np.intersect1d(x[p[i] : p[i + 1]], y[q[i] : q[i + 1]], assume_unique=True)) for i in range(b - a)], dtype=np.int64)
                keep = (shared > 0) & (den * shared >= num * (np.diff(p) + np.diff(q) - shared))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    met = pairs.join(texts.withColumnRenamed("node", "a"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    return met.select("a", "b", "text", "other").mapInArrow(verify, "a long, b long")


def _open_pairs(members: DataFrame, found: DataFrame, num: int, den: int, best: int | None) -> DataFrame | None:
    """Pairs (a, b) of different components that share large columns and may still be linked; None if there are none.

    ``members`` are the entries (column, node, n) of large columns, ``found`` (node, component).  A pair that shares a
    small column was checked already or cannot be linked, so all first columns that it shares are large, and pairs with
    fewer than a similar pair must share (``least_shared``) are discarded.  With ``best`` only the ``best`` pairs of each class and block are given, those with the largest
    part of their first columns in common.
    """
    labelled = members.join(found, "node", "left").select("column", "node", "n", F.coalesce("component", "node").alias("label"))
    labels = labelled.groupBy("column", "label").agg(F.count("*").alias("count"))
    open_columns = cut(labels.groupBy("column").agg(F.count("*").alias("labels"), F.sum("count").alias("count")).filter("labels > 1"))
    if open_columns.isEmpty():
        return None
    labelled = cut(lookup(labelled, open_columns.select("column", "count"), "column", "count").select("column", "node", "n", "label"))
    nodes = cut(labelled.groupBy("node", "n", "label").agg(F.collect_list("column").alias("columns")))  # a node's own first columns
    if nodes.count() <= LEFT:  # one block
        grouped = nodes.select(F.lit(0).cast("long").alias("group"), "label", "node", "n", "columns")
    else:
        # columns that share a component belong together, so that two classes meet once however many columns they share
        sides = labelled.select(F.xxhash64(F.lit("column"), "column").alias("a"), F.xxhash64(F.lit("label"), "label").alias("b")).distinct()
        groups = components(sides).select(F.col("node").alias("b"), F.col("component").alias("group"))
        grouped = cut(nodes.withColumn("b", F.xxhash64(F.lit("label"), "label")).join(groups, "b").select("group", "label", "node", "n", "columns"))
    sizes = grouped.groupBy("group", "label").agg(F.count("*").alias("count"))
    sizes = sizes.groupBy("group").agg(F.max(F.struct("count", "label")).alias("major"), F.sum("count").alias("count")).filter("major.count < count")
    sizes = sizes.select("group", F.col("major.label").alias("major"), F.ceil((F.col("count") - F.col("major.count")) / LEFT).alias("lefts"), F.ceil(F.col("count") / RIGHT).alias("rights"), "count")
    sizes = cut(sizes)
    copies = sizes.agg(F.sum((F.col("count") * (F.col("lefts") + F.col("rights"))).cast("double"))).first()[0] or 0
    turns = max(1, int(-(-copies // COPIES)))
    rows = cut(lookup(grouped, sizes, "group", "count"))
    hashed = lambda salt, parts: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts))
    each = lambda parts, turn, of: F.explode(F.sequence(F.lit(turn).cast("long"), F.col(parts) - 1, F.lit(of).cast("long")))
    kept = ("group", "i", "j", "label", "node", "n", "columns")

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})]
        if len(left) and len(right):
            terms, of = np.unique(np.concatenate(right["right_columns"].to_numpy()), return_inverse=True)
            owner = np.repeat(np.arange(len(right)), [len(c) for c in right["right_columns"]])[np.argsort(of, kind="stable")]
            begin = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(terms)))])  # the rows of a column are together
            rn, rl, rs = (right[f"right_{c}"].to_numpy() for c in ("node", "label", "n"))
            for s in range(0, len(left), 64):
                some = left.iloc[s : s + 64]
                ln, ll, ls = (some[c].to_numpy() for c in ("node", "label", "n"))
                own, who = np.concatenate(some["columns"].to_numpy()), np.repeat(np.arange(len(some)), [len(c) for c in some["columns"]])
                at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                at, who = at[terms[at] == own], who[terms[at] == own]
                size = begin[at + 1] - begin[at]
                shared = np.zeros(len(some) * len(right), dtype=np.int64)
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size) // COUNTED)) + 1):
                    n = size[part]
                    place = np.repeat(begin[at[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    shared += np.bincount(np.repeat(who[part] * len(right), n) + owner[place], minlength=len(shared))
                met = np.flatnonzero(shared)
                c, r, k = met // len(right), met % len(right), shared[met]
                x, z = ls[c].astype(np.int64), rs[r].astype(np.int64)
                fits = (k >= np.maximum(least_shared(x, z, num, den), 1)) & (den * np.minimum(x, z) >= num * np.maximum(x, z)) & (ll[c] != rl[r])
                c, r, k, x, z = (v[fits] for v in (c, r, k, x, z))
                made = pd.DataFrame({"a": ln[c], "b": rn[r]})
                if best is not None:
                    made["alike"] = k / (prefix_size(x, num, den) + prefix_size(z, num, den) - k)
                    made = made.sort_values(["alike", "b"], ascending=[False, True]).groupby("a").head(best)
                out.append(made[["a", "b"]])
        return pd.concat(out)

    def met(turn: int) -> DataFrame:
        """Pairs of the left blocks whose turn it is."""
        left = rows.filter("label != major").withColumn("i", hashed(1, "lefts")).filter(F.col("i") % turns == turn).withColumn("j", each("rights", 0, 1)).select(*kept)
        right = rows.filter(F.col("lefts") > turn).withColumn("j", hashed(2, "rights")).withColumn("i", each("lefts", turn, turns)).select(*kept)
        other = right.toDF(*(f"right_{c}" for c in kept))
        pairs = left.groupBy("group", "i", "j").cogroup(other.groupBy("right_group", "right_i", "right_j")).applyInPandas(product, "a long, b long")
        return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    pairs = met(0)
    if turns > 1:
        pairs = cut(reduce(DataFrame.union, [pairs, *(met(t) for t in range(1, turns))]).distinct())
    return None if pairs.isEmpty() else pairs


def near_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when ``den * shared >= num * union`` of their distinct ``width``-word shingles; the component is
    the smallest ``doc_id`` that links reach.  Null or wordless text has no shingle, links with nothing and is its own
    component.  Repeated rows each get their row.  An empty table gives no row; other columns are not read.
    """
    with scratch() as keep:
        frequent = frequent_shingles(docs, width)
        rows = cut(incidence(docs, frequent, width, num, den))
        classes = cut(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
        heads = classes.select(F.col("node").alias("_node"), "first_id")
        reps = rows.join(heads.hint("shuffle_hash"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "n", "columns")
        gathered = cut(column_pairs(cells(reps, frequent), num, den))
        sets = keep(cut(rows.select("doc_id", "n", "node")))
        drop(rows)  # its columns are most of what is written
        pairs = gathered.filter("b IS NOT NULL").drop("column")
        members = cut(gathered.filter("b IS NULL").select("column", F.col("a").alias("node"), F.col("x").alias("n")).dropDuplicates(["column", "node"]))
        counts = cut(members.groupBy("column").agg(F.count("*").alias("count")).filter("count > 1"))
        # frequent among the documents need not be frequent among the first columns of classes: these are small columns
        few = members.join(counts.filter(F.col("count") <= SMALL), "column").select("column", "node", F.col("n").alias("size"))
        pairs = pairs.union(column_pairs(few, num, den).filter("b IS NOT NULL").drop("column"))
        members = cut(lookup(members, counts.filter(F.col("count") > SMALL), "column", "count").select("column", "node", "n"))
        pairs = enough_shared(pairs, cut(members.groupBy("node").agg(F.count("*").alias("columns"))), num, den)
        # one order for the pivots of all columns: columns of the same classes have the same pivot, and their pairs are one
        pivots = cut(members.groupBy("column").agg(F.count("*").alias("count"), F.min(F.struct(F.xxhash64("node"), "node", "n")).alias("pivot")).filter("count > 1").select("column", "count", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("m")))
        starred = lookup(members, pivots, "column", "count").filter("node != pivot")
        near_size = F.lit(den) * F.least("n", "m") >= F.lit(num) * F.greatest("n", "m")
        stars = starred.filter(near_size).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        pairs = cut(pairs.union(stars).distinct())
        drop(gathered)
        large = members.join(pivots.select("column"), "column", "left_semi").select("node")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large).distinct().join(heads, F.col("node") == F.col("_node")).select("node", F.col("first_id").alias("_id"))
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
        texts = cut(_own_texts(named, width))
        links = cut(_linked(pairs, texts, width, num, den))
        found = components(links)
        members = cut(members.join(pivots.select("column"), "column", "left_semi"))
        tested = None
        for best in (BEST, 8 * BEST, None):  # the likeliest pairs join most components, so that few pairs are left for the rest
            more = _open_pairs(members, cut(found), num, den, best)
            if more is None:
                break
            if tested is not None:
                more = cut(more.join(tested, ["a", "b"], "left_anti"))
            tested = more if tested is None else tested.union(more)
            if more.isEmpty():
                continue
            links = cut(links.union(_linked(more, texts, width, num, den)))
            found = components(links)
        found = cut(found)
        least = found.join(classes, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = keep(cut(classes.join(found.join(least, "component").select("node", "component_id"), "node", "left").select("node", "copies", F.coalesce("component_id", "first_id").alias("component_id"))))
    met = lookup(sets.filter("node IS NOT NULL").select("doc_id", "n", "node"), named, "node", "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return met.unionByName(sets.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of its component; rows of one ``doc_id`` are one document,
    of which the row with the smallest text stays."""
    with scratch() as keep:
        rows = keep(cut(near_components(docs, width, num, den)))
    one, many = unused(docs, "_id", "_often")
    kept = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(one))
    often = cut(kept.groupBy(one).count().filter("count > 1").select(F.col(one).alias(many)))
    once = kept.join(often, F.col(one).eqNullSafe(F.col(many)), "left_anti")
    same = F.col("doc_id").cast("long")
    single = docs.join(once, same.eqNullSafe(F.col(one)), "left_semi")
    several = docs.join(often, same.eqNullSafe(F.col(many)), "left_semi")
    # these are repeated rows; a null id names no document, so all its rows stay
    first = several.filter("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", "text").dropDuplicates(["doc_id"])
    return single.unionByName(first).unionByName(several.filter("doc_id IS NULL"))
