"""Prefix trie of conversations by van Emde Boas recursion.

A forest of height H is cut at half depth.  The prefixes that reach the cut get a name (128 bits: an exclusive or over the
turns' position-salted digests, taken on the prefix of the root they hang on).  Sequences with the same cut prefix
are one sequence of the upper forest, which keeps the smallest member and the number of members; what follows the cut
is a sequence of a lower forest, whose root is the cut prefix.  Both halves are forests of height H / 2, and all
forests of one height are cut in the same job, so a trie of depth D takes log2 D rounds, whatever its shape.  At height
1 a node is a root and one turn.  Then totals are grafted upward, from small forests to large: the totals of a lower
tree go to the cut prefix it hangs on and to every node of the upper forest above that prefix.

Sequences lie in units of ``UNIT`` turns, one row each: forests of at most that height are cut inside a row, higher
ones between rows, so a conversation of any length is never one row or one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import lookup
from strandlab.operators.ordering import dense_index
from strandlab.session import cut

#: Turns of a row (a power of two), conversations whose heads are one family, most shared turns plus one, ids of a run.
UNIT, FAMILY, HEAD, RUN_BITS = 1024, 100, 6, 16
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()
ARRAYS = ("a", "b", "chars")


def _xor(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda x, y: x.bitwiseXOR(y))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, t, digest, chars): the turns of each conversation from t = 0; rows without ``conv_id`` belong to none.

    Turns are in order of ``turn``, null first; equal turns in order of the MD5 of role and text.  Null role or text is
    empty.  Repeated rows are separate turns.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return dense_index(rows, ["conv_id"], ["turn", "digest"]).select("conv_id", "t", "digest", "chars")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, digest, chars), and (conv_id, size) of every conversation, also of those without turns.

    Conversation c takes its first crc32(c) % 6 turns from conversation c - c % 100 (as many as that has) and keeps its
    own turns after as many.
    """
    sizes = ordered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD)
    heads = ordered.filter((F.col("t") < HEAD - 1) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("family")).agg(F.array_sort(F.collect_list(F.struct("t", "digest", "chars"))).alias("head"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    known = sizes.withColumn("family", family).join(heads, "family", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")))
    known = cut(known.select("conv_id", "n", "h", "head", F.size("head").cast("long").alias("taken")))
    shared = known.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.t").alias("pos"), "x.digest", "x.chars")
    own = lookup(ordered, known.select("conv_id", "n", "h", "taken"), "conv_id", "n").filter("t >= h")
    rows = shared.unionByName(own.select("conv_id", (F.col("t") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars"))
    return rows, known.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size"))


def units(rows: DataFrame, unit: int) -> DataFrame:
    """(seq, unit, a, b, chars): turns by ``unit`` of positions, in order; a and b are the two halves of a turn's digest at its place."""
    salted = [F.xxhash64("digest", "pos", F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"))]
    packed = rows.select(F.col("conv_id").alias("seq"), "pos", F.floor(F.col("pos") / unit).cast("long").alias("unit"), *salted, "chars")
    lists = packed.groupBy("seq", "unit").agg(F.array_sort(F.collect_list(F.struct("pos", *ARRAYS))).alias("x"))
    return lists.select("seq", "unit", *(F.col(f"x.{c}").alias(c) for c in ARRAYS))


def name_units(rows: DataFrame, last: int, unit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Units with the name (ra, rb) of the prefix they follow, and for each height the cuts (ca, cb, seq, block), low first.

    The recursion above a unit's height: at each cut the sequences that fill the upper half name it, and their lower
    units hang on that name.
    """
    named = rows.withColumns({"ra": F.lit(0).cast("long"), "rb": F.lit(0).cast("long")})
    cuts = []
    for level in range(last.bit_length(), 0, -1):
        lower = F.shiftright("unit", level - 1).bitwiseAND(F.lit(1)) == 1
        sums = named.filter(~lower).groupBy("ra", "rb", "seq").agg(
            F.bit_xor(_xor(F.col("a"), F.lit(0).cast("long"))).alias("ca"), F.bit_xor(_xor(F.col("b"), F.lit(0).cast("long"))).alias("cb"),
            F.sum(F.size("a")).alias("size"), F.max(F.shiftright("unit", level)).alias("block"),
        )
        full = cut(sums.filter(F.col("size") == unit << (level - 1)).select("ra", "rb", "seq", "block", F.col("ca").bitwiseXOR(F.col("ra")).alias("ca"), F.col("cb").bitwiseXOR(F.col("rb")).alias("cb")))
        down = named.filter(lower).join(full.drop("block"), ["ra", "rb", "seq"]).drop("ra", "rb").withColumnsRenamed({"ca": "ra", "cb": "rb"})
        named = cut(named.filter(~lower).unionByName(down))
        cuts.append(full.groupBy("ca", "cb").agg(F.min("seq").alias("seq"), F.max("block").alias("block")))
    return named, cuts[::-1]


def split(forest: DataFrame, half: int) -> DataFrame:
    """Forests of height 2 * ``half`` as forests of height ``half``: rows (ra, rb, lo, seq, n, a, b, chars, ca, cb).

    A row is a sequence below a root, with its members; (ca, cb) names the cut prefix of an upper sequence that
    reaches the cut, and is null in other rows.
    """
    size = F.size("a")
    name = [_xor(F.slice(x, 1, half), F.col(r)) for x, r in (("a", "ra"), ("b", "rb"))]
    below = size > half
    none = F.lit(None).cast("long")
    rest = forest.filter(size != half).select(
        *(F.when(below, c).otherwise(F.col(r)).alias(r) for c, r in zip(name, ("ra", "rb"))), F.when(below, F.col("lo") + half).otherwise(F.col("lo")).alias("lo"), "seq", "n",
        *(F.when(below, F.slice(c, half + 1, F.greatest(size - half, F.lit(0)))).otherwise(F.col(c)).alias(c) for c in ARRAYS), none.alias("ca"), none.alias("cb"),
    )
    upper = forest.filter(size >= half).select(name[0].alias("ca"), name[1].alias("cb"), "seq", "n", F.struct("ra", "rb", "lo", *(F.slice(c, 1, half).alias(c) for c in ARRAYS)).alias("x"))
    merged = upper.groupBy("ca", "cb").agg(F.min("seq").alias("seq"), F.sum("n").alias("n"), F.min_by("x", "seq").alias("x"))
    return rest.unionByName(merged.select("x.ra", "x.rb", "x.lo", "seq", "n", *(f"x.{c}" for c in ARRAYS), "ca", "cb"))


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (ra, rb, lo, a, b, leaves, saved) one row per prefix: its name, its parent's, its place, and the totals."""
    for batch in batches:
        size = np.asarray(batch.column("a").value_lengths(), dtype=np.int64)
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        out = []
        for flat, root in (("a", "ra"), ("b", "rb")):
            start = np.asarray(batch.column(root), dtype=np.int64)
            run = np.concatenate([[0], np.bitwise_xor.accumulate(np.asarray(batch.column(flat).flatten(), dtype=np.int64))])
            base = run[first] ^ start
            out += [run[1:] ^ base[row], run[:-1] ^ base[row]]
        place = np.arange(len(row)) - first[row] + np.asarray(batch.column("lo"), dtype=np.int64)[row]
        totals = [np.asarray(batch.column(c), dtype=np.int64)[row] for c in ("leaves", "saved")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (out[0], out[2], out[1], out[3], place, *totals)], names=["a", "b", "pa", "pb", "pos", "leaves", "saved"])


def graft(known: DataFrame, upper: DataFrame, level: int) -> DataFrame:
    """Totals that the lower trees of cut ``level`` add to the nodes above: ``upper`` has the path of every cut prefix."""
    tops = known.filter(F.col("pos").bitwiseAND(F.lit((1 << level) - 1)) == 1 << (level - 1))
    sums = tops.groupBy(F.col("pa").alias("ca"), F.col("pb").alias("cb")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    found = upper.join(sums, ["ca", "cb"]).select("ra", "rb", "lo", "a", "b", "leaves", "saved").mapInArrow(paths, "a long, b long, pa long, pb long, pos long, leaves long, saved long")
    return found.groupBy("a", "b", "pa", "pb", "pos").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the ascending, comma-joined ids of each node's rows (a, b, conv_id).

    Ids are joined in runs of at most 2**RUN_BITS; the runs of a node go through one hash in order, as its definition asks.
    """
    runs = ends.groupBy("a", "b", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids").to_pylist()):
                if (a, b) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"a": pa.array([d[0] for d in done], pa.int64()), "b": pa.array([d[1] for d in done], pa.int64()), "ends_sha256": pa.array([d[2] for d in done], pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"a": [now[0]], "b": [now[1]], "ends_sha256": [state.hexdigest()]})

    return runs.repartition("a", "b").sortWithinPartitions("a", "b", "run").mapInArrow(chained, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, unit: int = UNIT) -> DataFrame:
    """One row per node of the trie of rebuilt ``conversations`` (conv_id, turn, role, text); other columns are not read.

    ``conv_id`` is a node's smallest member, ``depth`` its number of turns (with ``conv_id`` its key), ``parent_conv_id``
    the parent's (null at the root), ``n_convs`` its members, ``n_children`` its children, ``n_leaves`` the childless nodes
    of its subtree, ``saved_tokens`` the code points of its subtree's turns that members share with a smaller one, and
    ``ends_sha256`` the digest of the members that end there.  Rows without ``conv_id`` are left out; null role or text
    is empty; see ``turns`` for ties.  A table without conversations gives no row, not even a root.
    """
    spark = conversations.sparkSession
    ordered = cut(turns(conversations))
    rows, convs = rebuilt(ordered)
    packed = cut(units(rows, unit))
    convs = cut(convs)
    last, height = packed.agg(F.max("unit"), F.max(F.size("a"))).first()
    if last is None and not convs.take(1):
        return spark.createDataFrame([], SCHEMA)
    named, high = name_units(packed, last or 0, unit)
    low = ((height or 1) - 1).bit_length()

    one = F.lit(None).cast("long")
    forest = named.select("ra", "rb", (F.col("unit") * unit).alias("lo"), "seq", F.lit(1).cast("long").alias("n"), *ARRAYS, one.alias("ca"), one.alias("cb"))
    levels = []
    for level in range(low, 0, -1):
        forest = cut(split(forest, 1 << (level - 1)))
        levels.append(forest.filter("ca IS NOT NULL"))
    levels.reverse()
    for level, cuts in enumerate(high, 1):
        at = cuts.withColumnsRenamed({"seq": "_seq", "block": "_block"})
        inside = (F.col("seq") == F.col("_seq")) & (F.shiftright("unit", level) == F.col("_block")) & (F.shiftright("unit", level - 1).bitwiseAND(F.lit(1)) == 0)
        levels.append(at.join(named, inside).select("ca", "cb", "ra", "rb", (F.col("unit") * unit).alias("lo"), "a", "b"))

    own = forest.groupBy(F.col("ra").bitwiseXOR(F.col("a")[0]).alias("a"), F.col("rb").bitwiseXOR(F.col("b")[0]).alias("b")).agg(
        F.max("ra").alias("pa"), F.max("rb").alias("pb"), F.max("lo").alias("pos"), F.min("seq").alias("rep"), F.sum("n").alias("n"), F.max(F.col("chars")[0]).alias("chars")
    )
    nodes = cut(own)
    children = nodes.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
    nodes = cut(nodes.withColumns({"leaves": (F.col("kids") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("chars")}).drop("chars"))
    known = nodes.select("a", "b", "pa", "pb", "pos", "leaves", "saved")
    grafts: list[DataFrame] = []
    for level, upper in enumerate(levels, 1):
        above = known
        for g in grafts:
            above = above.unionByName(g)
        grafts.append(cut(graft(above, upper, level)))

    full = nodes
    for g in grafts:
        full = full.unionByName(g, allowMissingColumns=True)
    trie = cut(
        full.groupBy("a", "b").agg(
            F.max("pa").alias("pa"), F.max("pb").alias("pb"), (F.max("pos") + 1).alias("depth"), F.max("rep").alias("rep"), F.max("n").alias("n"), F.max("kids").alias("kids"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        )
    )
    zero = F.lit(0).cast("long")
    tops = trie.filter("depth = 1").agg(F.count("*").alias("kids"), F.coalesce(F.sum("leaves"), zero).alias("leaves"), F.coalesce(F.sum("saved"), zero).alias("saved"))
    members = convs.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    root = members.unionByName(tops, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("rep", "n", "kids", "leaves", "saved")))  # one row each
    root = root.withColumns({"a": zero, "b": zero, "pa": one, "pb": one, "depth": zero, "leaves": F.greatest("leaves", F.lit(1).cast("long"))})
    full = trie.unionByName(root)

    parents = full.select(F.struct("a", "b").alias("parent"), F.col("rep").alias("parent_conv_id"), F.col("kids").alias("_kids"))
    hung = lookup(trie.withColumn("parent", F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))), parents, "parent", "_kids").drop("parent", "_kids")
    placed = hung.unionByName(root.withColumn("parent_conv_id", one))
    end = named.groupBy(F.col("seq").alias("conv_id")).agg(F.max_by(F.struct(_xor(F.col("a"), F.col("ra")).alias("a"), _xor(F.col("b"), F.col("rb")).alias("b")), "unit").alias("x"))
    ends = end.select("conv_id", "x.a", "x.b").unionByName(convs.filter("size = 0").select("conv_id", zero.alias("a"), zero.alias("b")))
    return placed.join(digests(ends), ["a", "b"], "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
