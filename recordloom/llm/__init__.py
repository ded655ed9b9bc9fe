"""Operators for training data made of text; nothing else in the package imports this subpackage."""
