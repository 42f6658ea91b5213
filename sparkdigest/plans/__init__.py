"""Whole pipelines of the digest and reminder engine."""
