"""Diagnostic triage on Spark: sources."""
