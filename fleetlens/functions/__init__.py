"""Column functions, time helpers and fixed vocabularies."""
