"""Document fingerprints: SimHash, in DataFrame functions only.

Terms are pairs of neighbouring words (lower-cased; the last word stands alone), weighted by their
number of occurrences times the length of their first word, so that short function words, which
all texts share, say little. The 64-bit hash of a term votes for or against every bit with its
weight; two bits are counted in one long, so a text's votes are 32 plain sums that run inside
code generation and are made before any shuffle.

The next document in doc_id order is found without a global sort: rows are dealt into buckets of
neighbouring ids (bounds are quantiles: at most ``MAX_BUCKETS`` numbers), and the first rows of each bucket
also come to the bucket before as guests. Texts are shuffled once.

``near_counts`` finds all fingerprints within a Hamming radius through permuted block tables: each
table brings another choice of blocks to the front as its key, and rows that agree there are verified.

Defined results: a null or empty text has fingerprint zero (no term has weight); null doc_ids come
last in order; repeated rows are neighbours of each other, ordered by the hash of the text; a single
row is its own next document; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import texts
from seqlake.llm.simhash_dedup import block_tables
from seqlake.session import settle

DOCS_PER_BUCKET = 1000
MAX_BUCKETS = 4096
BITS = 64
PAIR = (1 << 32) | 1


def terms(text: Column) -> Column:
    """Array of (first, second) words; one pair of an empty word and null for a text without words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[\\x09-\\x0d ]+", " ")), " ")
    return F.arrays_zip(words.alias("first"), F.slice(words, F.lit(2), F.size(words)).alias("second"))


def votes() -> list[Column]:
    """Per pair of bits (j, j + 32) the weight of the terms that have them, and the weight of all terms."""
    weighted = [F.sum(F.shiftright("hash", j).bitwiseAND(F.lit(PAIR)) * F.col("weight")).alias(f"v{j}") for j in range(32)]
    return [*weighted, F.sum("weight").alias("total")]


def majority() -> Column:
    out = F.lit(0).cast("bigint")
    for j in range(32):
        for votes_, bit in ((F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), j),
                            (F.shiftrightunsigned(f"v{j}", 32), j + 32)):
            value = (1 << bit) if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(2 * votes_ > F.col("total"), F.lit(value)).otherwise(F.lit(0)).cast("bigint"))
    return out


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / BITS


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds the id reaches, by binary search; null ids count as larger than all."""
    if not bounds:
        return F.lit(0)
    at, n = F.lit(bounds), len(bounds)
    steps = F.lit([1 << i for i in reversed(range(n.bit_length()))])

    def go(reached: Column, step: Column) -> Column:
        there = reached + step
        fits = (there <= n) & (F.element_at(at, F.least(there, F.lit(n))) <= doc_id)
        return F.when(fits, there).otherwise(reached)

    return F.coalesce(F.when(doc_id.isNotNull(), F.aggregate(steps, F.lit(0), go)), F.lit(n))


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with bucket, guest, place in the bucket, and next_text; guests are copies of
    the next bucket's first rows."""
    rows = docs.count()
    n = min(MAX_BUCKETS, max(1, math.ceil(rows / DOCS_PER_BUCKET)))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(found or []))
    dealt = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    low = {r["bucket"]: r["low"] for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("low")).collect()}
    full = sorted(low)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    lows = F.lit([low.get(b) for b in range(len(bounds) + 1)] or [None]).cast("array<bigint>")
    earlier = F.lit([before.get(b, 0) for b in range(len(bounds) + 1)])
    home = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))
    away = F.struct(F.element_at(earlier, F.col("bucket") + 1).alias("b"), F.lit(True).alias("guest"))
    first = F.col("doc_id").eqNullSafe(F.element_at(lows, F.col("bucket") + 1))
    placed = (dealt.withColumn("at", F.explode(F.when(first, F.array(home, away)).otherwise(F.array(home))))
              .select("doc_id", "text", F.col("at.b").alias("bucket"), F.col("at.guest").alias("guest")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return (placed.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp): one row per document row."""
    ordered = in_order(texts(docs, id_col, text_col))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = ordered.select("bucket", "guest", "place", "doc_id", n.cast("bigint").alias("n_chars"), "text",
                          F.when(~F.col("guest"), edited).alias("edited"))
    keyed = both.select("bucket", "guest", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        F.posexplode(F.array_compact(F.array("text", "edited"))).alias("version", "words"))
    key = ["bucket", "guest", "place", "doc_id", "n_chars", "edited_sha256"]
    # the hash skips a missing second word
    votes_ = (keyed.select(*key, "version", F.inline(terms(F.col("words"))).alias("first", "second"))
              .select(*key, "version", F.xxhash64("first", "second").alias("hash"),
                      F.octet_length("first").cast("bigint").alias("weight"))
              .groupBy(*key, "version").agg(*votes()))
    prints = (votes_.select(*key, "version", majority().alias("print"))
              .groupBy(*key).agg(F.max(F.when(F.col("version") == 0, F.col("print"))).alias("fp"),
                                 F.max(F.when(F.col("version") == 1, F.col("print"))).alias("edited_fp")))
    order = Window.partitionBy("bucket").orderBy("place")
    return (prints.withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("guest"))
            .select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"))


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, n_near): for every distinct ``fp`` of ``queries`` the rows of ``prints`` within ``radius`` bits, its own included."""
    tables = block_tables(radius, blocks)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(front)) for front, _ in tables])
    held = settle(prints.groupBy("fp").agg(F.count("*").alias("n")))
    asked = queries.select("fp").distinct()
    x = asked.select("fp", F.posexplode(keys).alias("t", "key")).alias("x")
    y = held.select("fp", "n", F.posexplode(keys).alias("t", "key")).alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = (F.col("x.fp") != F.col("y.fp")) & (F.bit_count(diff) <= radius)
    for i in range(radius):    # a pair counts in one table only
        must = F.array(*[F.lit(m[i]) for _, m in tables])
        near = near & (F.element_at(must, F.col("x.t") + 1).bitwiseAND(diff) != 0)
    others = (x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & near)
              .select(F.col("x.fp").alias("fp"), "n"))
    return (others.unionByName(asked.join(held, "fp").select("fp", "n"))
            .groupBy("fp").agg(F.sum("n").alias("n_near")))
