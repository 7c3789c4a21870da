"""Training-data operators: near-duplicate detection, fingerprints, token output, search,
language and quality models, mixing, packing and license scans.

Nothing else in the library imports this subpackage.
"""
