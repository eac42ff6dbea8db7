"""lustra: profiling, cleaning, validation, repair and scoring of tables on Spark.

Every operator takes and returns DataFrames built from Spark's own expressions.  Operators
that depend on data statistics come in two halves: ``fit`` runs one aggregation and returns
a handful of numbers, ``apply`` is a row-local projection with those numbers as literals, so
the same projection runs in batch and on a stream.
"""

__version__ = "0.1.0"
