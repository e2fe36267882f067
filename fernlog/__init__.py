"""Diagnostic triage on Spark."""
