"""Readers (CSV with the reference's NA rules), seeded samples, writers, session bundles."""
