"""Incremental and continuous refresh."""
