"""Operators for large training corpora: packing, deduplication, search, mixing, materialisation."""
