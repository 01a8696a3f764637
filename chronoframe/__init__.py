"""chronoframe: temporal analytics (time series and longitudinal tables) on Spark.

Operators take DataFrames and return DataFrames; ordered work runs on a dense
``idx`` built without a single-partition sort (see ``operators.ordering``).
"""

__version__ = "0.1.0"
