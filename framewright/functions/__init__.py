"""Scalar functions: label, key and hash normalisation, boxes, bit operations."""
