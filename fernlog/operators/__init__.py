"""Diagnostic triage on Spark: operators."""
