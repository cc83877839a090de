"""Training-data operators: licence scans, deduplication, decontamination, scoring, tokenising.

Nothing else in the library imports this subpackage.
"""
