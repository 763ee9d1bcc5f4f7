"""kredo: credit-risk data work as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
driver-side dict built from a bounded, already aggregated DataFrame).  The
heavy lifting is left to Catalyst: filters and projections reach the Parquet
scan, aggregates run partial + final, joins are picked by AQE at runtime.
"""

__version__ = "0.1.0"
