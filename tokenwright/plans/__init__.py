"""Whole audits: findings, projection, reports, gates and the command line."""
