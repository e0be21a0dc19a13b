"""Whole pipelines, and the invoices derived from the star schema."""
