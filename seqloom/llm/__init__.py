"""Operators for text and sequence corpora. Nothing else in the library imports this subpackage."""
