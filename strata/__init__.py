"""strata: a PySpark-native toolkit for batch and streaming data engineering."""
