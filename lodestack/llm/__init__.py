"""Training-data operators: archives, filters, near-duplicates, mixing, packing.

Nothing else in the library imports this subpackage.
"""
