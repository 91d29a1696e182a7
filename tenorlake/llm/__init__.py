"""Training-data operators: URL, text, duplicate, contamination, quality and token jobs.

Nothing else in the library imports this subpackage.
"""
