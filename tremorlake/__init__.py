"""Ground-motion sensor analytics on Spark: sources, Column functions, operators, query catalog, streams."""

__version__ = "0.1.0"
