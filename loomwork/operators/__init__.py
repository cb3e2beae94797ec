"""Operators that a request alone can't say."""
