"""teleloom: a Spark-native analytics library for traces, metrics and logs."""

__version__ = "0.1.0"
