"""Training-data operators: packing, deduplication, decontamination, filtering, encoding.

Nothing else in the library imports this subpackage.
"""
