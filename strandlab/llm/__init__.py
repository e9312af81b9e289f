"""Operators of a training-data pipeline over whole documents; nothing else in the library imports this package."""
