"""Analytics over text corpora and experiment logs, written for Spark."""
