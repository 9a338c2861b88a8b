"""Operators for text corpora: repair, measurement, encoding, packing and overlap."""
