"""Operators on texts for training data: splitting, packing, mixing. Nothing outside this package imports it."""
