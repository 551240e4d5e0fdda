"""Curation and evaluation of broken-to-fixed code pairs, as DataFrame transformations."""
