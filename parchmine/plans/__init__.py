"""Relational plans in SQL that Spark and the correctness oracle both read."""
