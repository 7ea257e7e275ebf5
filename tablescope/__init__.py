"""Table profiling and analytics on Spark DataFrames.

Every operator is a function ``name(df, ..., **defaults) -> DataFrame`` whose work runs as
Spark jobs over the whole table; the driver only ever sees per-column metadata.
"""
