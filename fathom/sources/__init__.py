"""Readers that turn files and side channels into tables."""
