"""Analytics over module corpora and training-data tables, written for Spark."""
