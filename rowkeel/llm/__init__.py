"""Training-data operators: mixing, near-dedup, language and quality models, packing and privacy.

Nothing else in the library imports this subpackage.
"""
