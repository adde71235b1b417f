"""Readers of recorded payloads and tables."""
