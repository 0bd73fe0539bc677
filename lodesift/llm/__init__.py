"""Operators for texts: credentials, syntax, token ids, mixing and subjects."""
