"""Streaming forms of the digest and reminder engine."""
