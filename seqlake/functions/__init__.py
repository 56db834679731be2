"""Column functions: pure Spark expressions (plus two Arrow helpers for Unicode normalisation)."""
from seqlake.functions.hashing import hash_int, seeded_hash  # noqa: F401
