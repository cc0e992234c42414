"""DataFrame operators: pseudo-labelling, set operations, splits, label
indexing, duplicate marking and metrics."""
