"""All registered queries and their SQL twins."""

import importlib

from strandlab.catalog.registry import ORACLES, QUERIES

for _name in ("tables_queries", "counts_queries", "learner_queries", "decode_queries", "moment_queries", "experiment_queries", "series_queries", "stream_queries"):
    importlib.import_module(f"strandlab.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
