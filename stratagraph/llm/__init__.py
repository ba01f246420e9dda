"""Operators for training data: text and vector problems."""
