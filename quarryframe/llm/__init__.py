"""Operators for training data made of text and code. Nothing outside this subpackage imports it."""
