"""Columns taken from path strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_from_path(df: DataFrame, path: str = "path", root: str = "", label: str = "label") -> DataFrame:
    """Class = first directory below ``root`` (a regular expression prefix); null if there is none."""
    found = F.regexp_extract(F.col(path), f"^{root}/*([^/]+)/", 1)
    return df.withColumn(label, F.when(found != "", found))


def read_labelled_text(spark, root: str, label: str = "label") -> DataFrame:
    """Text files in one directory per class, with the directory as class."""
    df = spark.read.option("recursiveFileLookup", "true").text(root)
    df = df.select(F.col("_metadata.file_path").alias("path"), "value")
    # the path part of the root, taken literally, after any scheme and host
    below = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/")
    return label_from_path(df, "path", f".*?\\Q{below}\\E", label)


def parse_path_fields(df: DataFrame, pattern: str, fields: list[str], path: str = "path") -> DataFrame:
    """One column per capture group of ``pattern`` plus ``valid``.

    A path that does not match keeps its row: its fields are null and ``valid``
    is false, so one bad name never stops a job.
    """
    ok = F.col(path).rlike(pattern)
    cols = {f: F.when(ok, F.regexp_extract(F.col(path), pattern, i + 1)) for i, f in enumerate(fields)}
    return df.withColumns(cols).withColumn("valid", F.coalesce(ok, F.lit(False)))


# Directory and file layout of a spoken-digit corpus
# usage / speaker type / speaker id / digits + production letter . extension
DIGIT_CORPUS_PATTERN = r"(train|test)/(man|woman|boy|girl)/([a-z]{2})/([1-9zo]+)([ab])\.(\w+)$"
DIGIT_CORPUS_FIELDS = ["usage", "speaker_type", "speaker_id", "digits", "production", "extension"]


def parse_digit_corpus(df: DataFrame, path: str = "path") -> DataFrame:
    return parse_path_fields(
        df.withColumn("_p", F.lower(F.translate(F.col(path), "\\", "/"))), DIGIT_CORPUS_PATTERN, DIGIT_CORPUS_FIELDS, "_p"
    ).drop("_p")


def parse_run_identifier(df: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """Attributes of an experiment, read from the end of its results path.

    Layout from the right: split, number of Gaussians, algorithm, topology,
    features, label table.  Shorter paths give nulls.
    """
    parts = F.split(F.regexp_replace(F.col(path), f"{sep}+$", ""), sep)
    names = ["split", "gaussians", "algorithm", "topology", "features", "label_table"]

    def from_end(k: int) -> Column:
        return F.when(F.size(parts) >= k, F.element_at(parts, -k))

    out = df.withColumns({n: from_end(i + 1) for i, n in enumerate(names)})
    digits = F.regexp_extract(F.col("gaussians"), r"(\d+)", 1)
    return out.withColumns(
        {
            "gaussians": F.when(digits != "", digits.cast("int")),
            "run_id": F.concat_ws("_", *[F.col(n) for n in reversed(names)]),
        }
    )
