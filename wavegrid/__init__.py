"""wavegrid: exact analytics over ordered integer signals, as Spark DataFrames."""

__version__ = "0.1.0"
