"""Spark-first engine for object models: class facts, call graphs, mappings, change logs."""

__version__ = "0.1.0"
