"""Diagnostic triage on Spark: functions."""
