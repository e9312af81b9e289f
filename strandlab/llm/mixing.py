"""Mix sources to target weights by fixed-length blocks.

The words of a source form one stream, cut into blocks of ``BLOCK`` words.  Every output shard draws how many of its
slots each source gets (multinomial); the n-th slot of a source maps through a pseudorandom permutation of the source's
block indexes, one permutation per pass over the source.  Slots and the stretches of documents meet by block index.
Draws that exceed what a source still has to give are left out, and what the draws leave short is filled in a last
shard, so a source gives its target to the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.shared import WORD, mix64, small_batches, unused
from strandlab.session import cut

#: Words of a block, slots of an output shard, share of all words that the mix holds, and how often a word may occur.
BLOCK, SHARD, SHARE, REPEATS = 128, 65_536, 1.5, 2
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a source that are put in order by one task.
ORDERED = 2_000
ROUNDS = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, docs, target) of each source of ``sizes`` (source, size); one row a source.

    Sources by code point, null last, weigh ``weights`` in turn.  With a common factor f a target is the smaller of
    f * weight and ``repeats`` * size; f is found where the sources, in the order in which they reach their bound,
    stop reaching it.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    table = table.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1))
    bound = repeats * F.col("source_size")
    full = table.withColumn("bound", bound.cast("double")).withColumn("ratio", F.col("bound") / F.col("weight"))
    up = Window.orderBy("ratio", "rank")
    full = full.withColumn("wanted", share * F.sum("source_size").over(Window.partitionBy()))
    full = full.withColumn("bound_before", F.coalesce(F.sum("bound").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    full = full.withColumn("weight_from", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # the factor if exactly the sources before this one are at their bound; the first that holds it below its own bound is right
    full = full.withColumn("factor", (F.col("wanted") - F.col("bound_before")) / F.col("weight_from"))
    factor = F.min(F.when(F.col("factor") <= F.col("ratio"), F.struct("ratio", "rank", "factor"))).over(Window.partitionBy())["factor"]
    full = full.withColumn("f", factor).withColumn("target", F.when(F.col("f").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("f") * F.col("weight"))))
    return full.select("source", "rank", "source_size", "docs", "target")


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place of each index under a pseudorandom permutation of 0 .. size-1 (swap-or-not), element by element."""
    x, n = index.astype(np.int64), np.maximum(size.astype(np.int64), 1)
    for r in range(ROUNDS):
        with np.errstate(over="ignore"):
            key = mix64(seed.astype(np.uint64) * np.uint64(2 * ROUNDS + 1) + np.uint64(2 * r + 1))
            partner = ((key % n.astype(np.uint64)).astype(np.int64) - x) % n
            high = np.maximum(x, partner)
            swap = (mix64(high.astype(np.uint64) ^ mix64(key)) & np.uint64(1)).astype(bool)
        x = np.where(swap, partner, x)
    return x


def with_offsets(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with the words of its source before each document, ordered by a hash of the id inside the source.

    A large source is ordered in buckets of about ``ORDERED`` documents, so no task holds a whole source.
    """
    rows = sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "content"), F.ceil(F.col("docs") / ORDERED)))
    buckets = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(buckets.select("rank", "bucket", before.alias("base")), ["rank", "bucket"])
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("doc_id", "content", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("offset", F.col("base") + inside)


def slots(sources: DataFrame, seed: int = 7, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, rank, epoch, block, length): the mix, slot by slot; ``length`` words from the block's start are taken.

    The table of sources (one row each, as configured for a mix) is read by the driver.
    """
    spark = sources.sparkSession
    known = sources.filter("source_size > 0").orderBy("rank").collect()
    size = np.array([r["source_size"] for r in known], dtype=np.int64)
    wanted = np.array([round(r["target"]) for r in known], dtype=np.int64)
    rank = np.array([r["rank"] for r in known], dtype=np.int64)
    blocks = -(-size // block)
    short = size - (blocks - 1) * block  # words of the last, short block
    epochs, left = wanted // np.maximum(size, 1), wanted % np.maximum(size, 1)
    key = mix64(np.uint64(seed) * np.uint64(1 << 20) + rank.astype(np.uint64) * np.uint64(64))
    # in the pass that is not whole, blocks are taken in permuted order up to the wanted words; the short block comes at its place
    place = np.array([_place(int(b) - 1, int(b), k + np.uint64(e)) for b, k, e in zip(blocks, key, epochs)], dtype=np.int64)
    plain = -(-left // block)
    more = np.where(plain > place, -(-(left + block - short) // block), plain)
    need = epochs * blocks + more
    total = int(need.sum())
    shards = -(-total // shard) if total else 0
    chance = need / total if total else need

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["id"]:
                counts = np.random.default_rng([seed, int(s)]).multinomial(min(shard, total - int(s) * shard), chance)
                yield pd.DataFrame({"shard": s, "place": np.arange(len(rank)), "slots": counts})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, place int, slots long")
    first = F.coalesce(F.sum("slots").over(Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = cut(drawn.withColumn("first", first))
    ends = {r["place"]: r["n"] for r in drawn.groupBy("place").agg(F.sum("slots").alias("n")).collect()}
    rest = [(shards, i, int(n - ends.get(i, 0)), int(ends.get(i, 0))) for i, n in enumerate(need) if n > ends.get(i, 0)]
    if rest:
        drawn = drawn.unionByName(spark.createDataFrame(rest, "shard long, place int, slots long, first long"))
    # a long run of slots is cut, so that no row explodes to more than one shard's slots
    pieces = drawn.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("slots") - 1) / shard).cast("int")))))
    pieces = pieces.select("shard", "place", (F.col("first") + F.col("piece") * shard).alias("first"), F.least(F.lit(shard), F.col("slots") - F.col("piece") * shard).alias("slots"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, p, begin, count in batch.itertuples(index=False):
                n = np.arange(begin, min(begin + count, need[p]), dtype=np.int64)
                epoch, at = n // blocks[p], n % blocks[p]
                index = permuted(at, np.full(len(n), blocks[p]), key[p] + epoch.astype(np.uint64))
                length = np.where(index == blocks[p] - 1, short[p], block)
                last = epoch == epochs[p]
                words = at * block - np.where(at > place[p], block - short[p], 0)  # taken before, in the pass that is not whole
                length = np.where(last, np.minimum(length, left[p] - words), length)
                yield pd.DataFrame({"shard": s, "rank": rank[p], "epoch": epoch, "block": index, "length": length})

    return pieces.repartition("shard", "place", "first").mapInPandas(spread, "shard long, rank int, epoch long, block long, length long")


def _place(index: int, size: int, seed: np.uint64) -> int:
    """Where ``index`` comes in the permutation: the inverse, round by round backwards."""
    x, n = index, max(size, 1)
    for r in reversed(range(ROUNDS)):
        with np.errstate(over="ignore"):
            key = mix64(np.array([seed], dtype=np.uint64) * np.uint64(2 * ROUNDS + 1) + np.uint64(2 * r + 1))
            partner = (int(key[0] % np.uint64(n)) - x) % n
            swap = int(mix64(np.array([max(x, partner)], dtype=np.uint64) ^ mix64(key))[0]) & 1
        x = partner if swap else x
    return x


def mix_documents(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, taken): each row of ``docs`` (doc_id, text, source) with its size, source_size, target and taken words,
    and the stretches that the mix takes: (row, epoch, begin, words), counted in words of the document.

    Null text has size 0; null is a source of its own, the last.  Repeated rows are documents of their own.  A source
    without words has target 0.  An empty table gives empty tables; other columns are not read.  The same rows give
    the same mix in every run.
    """
    sizes = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("content"), word_count(F.col("text")).alias("size")))
    sources = cut(source_targets(sizes))
    rows = cut(with_offsets(sizes, sources).select("row", "doc_id", "content", "size", "source_size", "target", "rank", "offset"))
    low, high = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    stretches = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("offset"), F.col("block") * block)
    stretches = stretches.select("rank", "block", "row", (begin - F.col("offset")).alias("begin"), (begin - F.col("block") * block).alias("at"), (F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("words"))
    # slots are made from a few rows a shard; their number, not the size of these rows, decides how they are joined
    met = stretches.join(slots(sources, seed, block).hint("merge"), ["rank", "block"])
    words = F.least(F.col("words"), F.col("length") - F.col("at"))
    taken = met.withColumn("words", words).filter("words > 0").select("row", "epoch", "begin", "words")
    return rows, cut(taken)


def mixture(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    rows, taken = mix_documents(docs, seed)
    sums = taken.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass that takes words of it, with the text of these words.

    A document of which a pass takes all words keeps its text as it is; else stretches of words are joined by a line
    feed.  ``n_chars``, if there is such a column, counts the new text.  Rows repeated under one id and text share
    their stretches: each of them comes once for each pass.
    """
    rows, taken = mix_documents(docs, seed)
    stretch = F.sort_array(F.collect_list(F.struct("begin", "words")))  # a document's stretches, as many as its blocks
    passes = taken.join(rows.select("row", "doc_id", "content", "size"), "row").groupBy("row", "epoch", "doc_id", "content", "size").agg(stretch.alias("stretches"), F.sum("words").alias("n"))
    first = passes.groupBy("doc_id", "content").agg(F.min("row").alias("row"))  # equal rows: the stretches of the first
    same, i, content, whole, stretches = unused(docs, "_same", "_id", "_content", "_whole", "_stretches")
    passes = passes.join(first.select("row"), "row", "left_semi").select(F.col("doc_id").alias(i), F.col("content").alias(content), (F.col("n") == F.col("size")).alias(whole), F.col("stretches").alias(stretches))
    met = docs.withColumn(same, F.xxhash64("text")).join(passes, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(same) == F.col(content)))

    names = docs.columns

    def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            for r, all_of in enumerate(batch.column(whole).to_pylist()):
                if all_of:
                    continue
                words, made, at = texts[r].encode().split(), [], -1
                for part in batch.column(stretches)[r].as_py():
                    made.append((b"" if not made else b" " if part["begin"] == at else b"\n") + b" ".join(words[part["begin"] : part["begin"] + part["words"]]))
                    at = part["begin"] + part["words"]
                texts[r] = b"".join(made).decode()
            kept = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(kept, names=names)

    made = met.select(*names, whole, stretches).mapInArrow(cut_words, docs.schema)
    if "n_chars" in names:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made
