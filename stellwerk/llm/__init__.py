"""Operators for text: names, towns, page bodies, template residue, truncation, tokens, mixing, sentences."""
