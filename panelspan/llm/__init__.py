"""Training-data operators: reading archives, scoring, counting, deduplicating and cleaning text.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
