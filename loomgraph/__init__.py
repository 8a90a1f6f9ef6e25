"""loomgraph: nested-source mapping, column profiling and graph statistics on Spark DataFrames."""

__version__ = "0.1.0"
