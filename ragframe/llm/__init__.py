"""Training-data operators: cleaning, scoring, search, packing, tokens, near duplicates, personal data, archives.

Nothing else in the library imports this subpackage.
"""
