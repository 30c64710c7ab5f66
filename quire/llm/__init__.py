"""Training-data operators: scoring, formatting, scans, language id, mixing,
search, token counts, packing, fingerprints and near-duplicate removal.

Nothing else in the library imports this subpackage.
"""
