"""Training-data operators for large text and vector corpora.

Nothing else in the library imports this subpackage; it stands alone.
"""
