"""Operators of a large-scale training-data pipeline (line dedup, PII, quality rules, URL filters,
decontamination, sharding, mixing, SimHash, substring dedup, language identification, embedding
whitening, MinHash, conversation prefix tries).

Nothing else in the library imports this subpackage.
"""
