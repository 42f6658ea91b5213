"""Column functions of the digest and reminder engine."""
