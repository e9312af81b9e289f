"""Reading and writing labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.exprs import clean_number


def load_instances(
    spark: SparkSession,
    path: str,
    label: str = "last",
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """Read a table; ``label`` is a column name, ``first`` or ``last``.

    The class column is renamed to ``label`` and rows keep NULL for missing; NaN
    in floating columns becomes NULL.  Only ``columns`` reach the scan.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.format(fmt).load(path)
    if columns is not None:
        df = df.select(*columns)
    name = {"first": df.columns[0], "last": df.columns[-1]}.get(label, label)
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    kept = [clean_number(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.col(name).alias("label"))


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """Read a parquet table for row-wise heavy work.

    A table stored in fewer pieces than there are cores (one row group, say) would
    be scored by as few tasks, so it is spread once after the scan; a large table
    already has more pieces and is left alone.  Filters and pruned columns still
    reach the scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def sanitize_nominals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Make nominal values and column names safe for delimited rule tools.

    ``- / & space '`` become ``R``; a value starting with a digit gets the prefix
    ``V`` and a column name starting with a digit the prefix ``N``.
    """
    fixed = {}
    for c in cols:
        v = F.translate(F.col(f"`{c}`"), "-/& '", "RRRRR")
        fixed[c] = F.when(v.rlike("^[0-9]"), F.concat(F.lit("V"), v)).otherwise(v)
    out = df.withColumns(fixed)
    return out.withColumnsRenamed({c: f"N{c}" for c in cols if c[:1].isdigit()})


def class_domain(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct class values with their position in sorted order."""
    values = df.select(F.col(label).alias("label")).filter(F.col("label").isNotNull()).distinct()
    ordered = values.agg(F.array_sort(F.collect_set("label")).alias("v"))
    return ordered.select(F.posexplode("v").alias("pos", "label"))


def write_delimited(df: DataFrame, path: str, label: str = "label", sep: str = ",") -> None:
    """Delimited rows under ``path/data`` and the sorted class values under ``path/names``."""
    df.write.mode("errorifexists").option("sep", sep).option("nullValue", "?").csv(f"{path}/data")
    names = class_domain(df, label).orderBy("pos").agg(F.array_join(F.collect_list("label"), ", ").alias("names"))
    names.write.mode("errorifexists").text(f"{path}/names")


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append two tables whose columns and types must match."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise ValueError(f"schemas differ: {sorted(set(a.dtypes) ^ set(b.dtypes))}")
    return a.unionByName(b)
