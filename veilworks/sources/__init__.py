"""Readers of the tables and of files."""
