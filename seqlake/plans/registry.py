"""The query registry shared by ``__spark_entry__`` and ``bench.py``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


# SQL fragment shared by the oracle statements: the DNA view of `documents`.
DNA_CTE = """dna AS (
  SELECT doc_id AS seq_id, lang AS source, source AS species,
         regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'),
                        '[^ACGT]', 'N', 'g') AS sequence
  FROM documents)"""


def H(key: str, seed: int = 42) -> str:
    """SQL form of the seeded hash."""
    return f"md5(concat('{seed}', '|', CAST({key} AS VARCHAR)))"


def HINT(key: str, seed: int = 42) -> str:
    return f"('0x' || substr({H(key, seed)}, 1, 8))::BIGINT"


def r6(c) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (same as ``round(x, 6) + 0.0`` in SQL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)
