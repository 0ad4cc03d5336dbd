"""Scalar functions over keys: byte order, tags, checksums, separators, filters and file names."""
