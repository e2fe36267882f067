"""Diagnostic triage on Spark: jobs."""
