"""Column functions: text rules, JSON recovery, vectors and vocabularies."""
