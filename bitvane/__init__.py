"""bitvane: nearest-neighbour retrieval over vectors and sign codes, on Spark DataFrames."""

__version__ = "0.1.0"
