"""Ingest and publish."""
