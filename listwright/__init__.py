"""Listing ingest, merge, triage, scoring and review as Spark DataFrame jobs."""
