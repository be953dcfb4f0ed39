"""Queries over the project's tables and their SQL."""
