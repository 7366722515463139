"""relweave: exact relation discovery, accounted lossless coding and corpus operators on Spark DataFrames."""

__version__ = "0.1.0"
