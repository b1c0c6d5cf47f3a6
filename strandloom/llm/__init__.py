"""Operators for training data: everything in here is optional for the rest of the library."""
