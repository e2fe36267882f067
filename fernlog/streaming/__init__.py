"""Diagnostic triage on Spark: streaming."""
