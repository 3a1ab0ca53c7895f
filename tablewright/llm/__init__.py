"""Training-data operators: deduplication, decontamination, filtering, scanning and mixing of corpora.

Nothing else in the library imports this subpackage.
"""
