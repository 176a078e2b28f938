"""Training-data operators: deduplication, classifiers, formatting, mixing, packing.

Nothing else in the library imports this subpackage.
"""
