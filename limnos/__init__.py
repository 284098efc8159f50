"""limnos — time-series preparation, profiling and forecasting on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, aggregates, joins and windows, so it composes with
``df.transform(...)`` and is planned by Catalyst as one lazy query.
"""

__version__ = "0.1.0"
