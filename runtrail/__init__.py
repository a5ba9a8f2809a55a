"""runtrail: behavioural event-log analytics and corpus processing as Spark DataFrames."""

__version__ = "0.1.0"
