"""Merkle trees over the sections and paragraphs of documents.

Sections end with a blank line, paragraphs with a line feed; the leaves of a paragraph are slices that start anew at
every sentence.  A node is the digest of its children's digests, so equal roots mean equal texts, and only children
under differing nodes need a look.  The fingerprint is the tree as text:
``root section(paragraph[leaf,leaf] paragraph[...]) section(...)``.
Everything is built-in SQL functions; the neighbour of a document comes from a window inside ranges of ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a slice, hex digits of an inner digest.
SLICE, DIGITS = 48, 16
SECTION, PARAGRAPH, LEAF = r"[\s\S]+?(?:\n\n+|\z)", r"[^\n]*\n|[^\n]+", rf"[^.!?]{{1,{SLICE}}}[.!?]*[ \n]*|[.!?]+[ \n]*"
#: Rows of an id range, and the most ranges (the bound of what the driver and every task hold of them).
RANGE_ROWS, MOST_RANGES, STEP = 1_000, 65_536, 256
LOWEST = -(1 << 63)


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, DIGITS)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name_leaves`` (section, paragraph, leaf digests), ``name_root`` and the text form ``name``."""
    all_of = lambda column, pattern: F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    df = df.withColumn(f"{name}_tree", F.transform(all_of(F.col(text), SECTION), lambda s: F.transform(all_of(s, PARAGRAPH), lambda p: F.transform(all_of(p, LEAF), _digest))))
    df = df.withColumn(
        f"{name}_nodes",
        F.transform(f"{name}_tree", lambda s: F.transform(s, lambda p: F.struct(_digest(F.array_join(p, "")).alias("d"), F.array_join(p, ",").alias("l")))),
    )
    df = df.withColumn(
        f"{name}_sections",
        F.transform(f"{name}_nodes", lambda s: F.struct(_digest(F.array_join(F.transform(s, lambda p: p["d"]), "")).alias("d"), F.array_join(F.transform(s, lambda p: F.concat(p["d"], F.lit("["), p["l"], F.lit("]"))), " ").alias("t"))),
    )
    df = df.withColumn(f"{name}_root", F.sha2(F.array_join(F.transform(f"{name}_sections", lambda s: s["d"]), "").cast("binary"), 256))
    form = F.array_join(F.transform(f"{name}_sections", lambda s: F.concat(s["d"], F.lit("("), s["t"], F.lit(")"))), " ")
    df = df.withColumn(name, F.when(F.size(f"{name}_sections") == 0, F.col(f"{name}_root")).otherwise(F.concat(F.col(f"{name}_root"), F.lit(" "), form)))
    df = df.withColumn(f"{name}_leaves", F.array_distinct(F.flatten(F.flatten(f"{name}_tree"))))
    return df.drop(f"{name}_tree", f"{name}_nodes", f"{name}_sections")


def likeness(root: str, leaves: str, other_root: str, other_leaves: str) -> Column:
    """Twice the leaves that two trees share, of all their distinct leaves; 1 for equal roots."""
    both = F.size(leaves) + F.size(other_leaves)
    return F.when(F.col(root) == F.col(other_root), 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(leaves, other_leaves)) / both)


def differing_leaves(leaves: str, other_leaves: str) -> Column:
    """The leaves of one tree that the other lacks: where an edit is."""
    return F.array_except(leaves, other_leaves)


def id_ranges(docs: DataFrame) -> list[int]:
    """First ids of consecutive id ranges of about equal row counts; at most ``MOST_RANGES`` of them."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"))
    rows = ids.count()
    ranges = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS)))
    firsts = ids.repartitionByRange(ranges, "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id"))
    return sorted({r["id"] for r in firsts.collect()})


def with_next(docs: DataFrame) -> tuple[DataFrame, object]:
    """Rows (id, text, next, border) and the window that orders them.

    A row goes to the range of its id; the first row of a range goes to the range before as well, marked ``border``,
    and the first of all, marked ``wrap``, to the end of the last.
    """
    firsts = id_ranges(docs) or [LOWEST]
    known = F.lit(np.array(firsts, dtype=np.int64))
    coarse = F.lit(np.array(firsts[::STEP], dtype=np.int64))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(LOWEST)))
    rows = rows.withColumn("block", F.size(F.filter(coarse, lambda x: x <= F.col("id"))) - 1)
    rows = rows.withColumn("range", F.col("block") * STEP + F.size(F.filter(F.slice(known, F.col("block") * STEP + 1, F.lit(STEP)), lambda x: x <= F.col("id"))) - 1)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("border"), F.lit(False).alias("wrap"))
    other = F.struct(F.pmod(F.col("range") - 1, F.lit(len(firsts))).cast("int").alias("range"), F.lit(True).alias("border"), (F.col("range") == 0).alias("wrap"))
    places = F.when(F.element_at(known, F.col("range") + 1) == F.col("id"), F.array(own, other)).otherwise(F.array(own))
    rows = rows.select("doc_id", "id", "text", F.explode(places).alias("place")).select("doc_id", "id", "text", "place.*")
    order = Window.partitionBy("range").orderBy("wrap", "id", "text", "border")
    return rows.withColumn("next", F.lead("text").over(order)), order


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document follows in ascending ``doc_id`` (null first, ties by text) and after the last comes the first, so
    a lone document follows itself; rows tied with the first all count as first.  Null text is empty: its root is the
    digest of nothing.  Repeated rows follow one another.  An empty table gives no row; other columns are not read.
    """
    rows, order = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.when(~F.col("border"), F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring(F.col("next"), F.lit(1), F.col("half")))))
    rows = with_tree(rows, "text", "fingerprint").withColumn("next_root", F.lead("fingerprint_root").over(order)).withColumn("next_leaves", F.lead("fingerprint_leaves").over(order))
    rows = with_tree(rows.filter(~F.col("border")).drop("text", "next"), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint_root", "fingerprint_leaves", "edited_fingerprint_root", "edited_fingerprint_leaves").alias("near_edited"),
        likeness("fingerprint_root", "fingerprint_leaves", "next_root", "next_leaves").alias("near_next"),
    )
