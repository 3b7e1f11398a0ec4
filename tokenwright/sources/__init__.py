"""Readers that turn files, records and tables into the `requests` DataFrame."""
