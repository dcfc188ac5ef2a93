"""Operators for preparing training text: packing, sharding, search, PII, quality,
language, token counts, mixing and near-duplicate removal.

Nothing outside this subpackage imports it.
"""
