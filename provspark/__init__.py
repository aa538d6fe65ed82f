"""provspark: processing records, fingerprints, comparison and lineage as Spark DataFrames."""

__version__ = "0.1.0"
