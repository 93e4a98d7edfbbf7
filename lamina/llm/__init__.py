"""Training-data operators: search, sharding, scans, packing, scoring and near-duplicates.

Nothing else in the package imports this subpackage.
"""
