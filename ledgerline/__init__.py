"""ledgerline: commerce data jobs (stock reconciliation, snapshot diff, upsert,
change feeds, catalogue, orders, data quality, text cleaning) written as
Spark DataFrame plans.

Every operator takes DataFrames (plus column names / options) and returns a
DataFrame built from Spark SQL expressions, so the same code runs in batch,
inside ``foreachBatch`` of a stream, on a laptop or on a cluster.
"""

__version__ = "0.1.0"
