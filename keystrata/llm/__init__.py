"""Operations of a training-data pipeline: counting, scoring, searching, sharding,
encoding, extracting, mixing, decontaminating and deduplicating text tables.

Nothing else in ``keystrata`` imports this subpackage.
"""
