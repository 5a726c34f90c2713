"""Composite plans: pipeline, reports, narratives."""
