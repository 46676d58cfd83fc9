"""Column builders: CIGAR, flags, qualities, tags, selectors."""
