"""Operators on training data; nothing outside this subpackage imports it."""
