"""Scans: query grammars, raw payload readers, mappings to the paper schema, and the table of sources."""
