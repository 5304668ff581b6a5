"""Whole queries: identification, discovery, related work, responses."""
