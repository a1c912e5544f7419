"""Operators put together: the whole-trace analysis and its stored form."""
