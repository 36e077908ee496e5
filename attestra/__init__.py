"""Integrity-constraint auditing for tables and predictions, on Spark."""
