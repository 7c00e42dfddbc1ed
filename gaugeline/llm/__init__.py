"""Training-data operators: filters, classifiers, personal data, search, packing, deduplication, mixing, fingerprints.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames and keeps intermediate tables,
where it needs any, below the shared folder of the session.
"""
