"""Relational operators of the key-value engine: writes, reads, merges, compaction and metadata."""
