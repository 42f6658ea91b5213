"""Readers and writers of the digest and reminder engine."""
