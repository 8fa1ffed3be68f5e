"""Column builders: vectors, boxes, text, retrieval metrics."""
