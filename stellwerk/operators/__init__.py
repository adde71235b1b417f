"""Relational and data-cleaning operators."""
