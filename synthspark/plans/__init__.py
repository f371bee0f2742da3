"""Verdicts, reports and the catalogue of queries."""
