"""strata: coded-survey analytics on Spark (DataFrames, Spark SQL, Spark ML).

See README.md for the layout and ``__spark_entry__.py`` for the registered queries.
"""

__version__ = "0.1.0"
