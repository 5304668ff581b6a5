"""Operators for preparing bibliographic training data; nothing outside this package imports it."""
