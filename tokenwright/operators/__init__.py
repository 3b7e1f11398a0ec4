"""Checks, rewrites and corpus totals over `requests`."""
