"""HTML documents: a tolerant tree builder and the operators over it."""
