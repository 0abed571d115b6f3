"""Operators on training data.  Nothing outside this subpackage imports it."""
