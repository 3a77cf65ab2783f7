"""Panel and time-series-cross-section analytics as lazy DataFrame operations on Spark."""
