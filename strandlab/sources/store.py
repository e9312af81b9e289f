"""Result store: compute only what is not stored yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def missing_keys(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key rows that have no stored result."""
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def merge_results(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows win; new rows are added for unseen keys."""
    return stored.unionByName(missing_keys(new, stored, keys))


def append_results_once(
    spark: SparkSession,
    path: str,
    wanted: DataFrame,
    keys: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Compute results for keys that are not stored, append them, return all wanted.

    ``compute`` gets only the missing key rows, so finished work is never redone.
    """
    try:
        stored = spark.read.parquet(path)
        todo = missing_keys(wanted, stored, keys)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # a store that cannot be read is a fault, not an empty store
        todo = wanted
    if len(todo.take(1)):
        compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(*keys).distinct(), list(keys), "left_semi")
