"""Relational operators of the digest and reminder engine."""
