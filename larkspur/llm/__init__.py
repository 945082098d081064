"""Training-data operators: deduplication, joins, packing, mixing, search, classifiers, audits.

Nothing outside this subpackage imports it.
"""
