"""strandlab: learning from, scoring and comparing models on large labelled
tables and frame sequences, expressed as Spark DataFrame work."""

from strandlab.session import build_session

__all__ = ["build_session"]
