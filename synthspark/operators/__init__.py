"""Operators on one table or on a pair of a real and a synthetic table."""
