"""Spark-native medallion analytics: sources, operators, functions, plans and streaming."""
