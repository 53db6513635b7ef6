"""Pipelines, recommendations and the SQL/filter surface."""
