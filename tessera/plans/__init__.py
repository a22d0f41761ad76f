"""Whole plans: the prompt context and the catalogue of queries."""
