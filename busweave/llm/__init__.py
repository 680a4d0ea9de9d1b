"""Operators for text and language-model training data. Nothing outside this subpackage imports it."""
