"""Operators for preparing training data; each module is independent of the rest of the library."""
