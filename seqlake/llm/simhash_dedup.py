"""SimHash near-dedup: pigeonhole blocks.

A text's fingerprint is the majority vote of the XXH64 hashes of its word shingles. Fingerprints
are first collapsed to distinct values (thousands of copies become one node). Each distinct
fingerprint is cut into ``blocks`` blocks; two fingerprints that differ in at most ``d`` bits
agree in at least ``blocks - d`` blocks, so every choice of that many blocks forms a join key, and
pairs joined on a key are verified by Hamming distance. A pair is reported by one key only (the
choice whose left-out blocks are the smallest possible), so no link is emitted twice. With the
default eight blocks and two bits a bucket fixes 48 bits and cannot hold more than 2^16
distinct fingerprints, however many documents there are.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle of all words; repeated rows each get the component of their
fingerprint; a null doc_id takes part in links but never names a component (a component of null
ids only has a null id); an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import free_name, small_batches, texts
from seqlake.llm.components import components
from seqlake.session import settle

HASH_SEED = 42
VOTE_ROWS = 1 << 15    # shingles voting at once: bounds the unpacked bit matrix of a long text


def simhash(text: str, shingle_words: int) -> int:
    """Majority bits of the shingle hashes as an unsigned 64-bit integer."""
    words = text.encode("utf-8", "replace").lower().split()   # bytes: ASCII case and white space only
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), HASH_SEED) for s in zip(*(words[i:] for i in range(shingle_words)))],
                      dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), VOTE_ROWS):
        bits = np.unpackbits(hashes[at:at + VOTE_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 *carried: str) -> DataFrame:
    """(doc_id, fp long) and the columns ``carried``: one row per document row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle_words) for t in text], dtype=np.uint64).view(np.int64))

    return texts(docs, id_col, text_col, *carried).select("doc_id", fp("text").alias("fp"), *carried)


def block_tables(max_bits: int, blocks: int) -> list[tuple[int, list[int]]]:
    """Per choice of left-out blocks: the mask of the kept bits, and masks that must differ in a pair."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    mask = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for left_out in combinations(range(blocks), max_bits):
        kept = ((1 << 64) - 1) ^ sum(mask[i] for i in left_out)
        must = [mask[i] if any(j not in left_out for j in range(i)) else (1 << 64) - 1 for i in left_out]
        out.append((signed(kept), [signed(m) for m in must]))
    return out


def near_links(nodes: DataFrame, max_bits: int = 2, blocks: int = 8) -> DataFrame:
    """(a, b) for every two values of the distinct column ``fp`` at 1..max_bits differing bits. Both sides are dealt out by
    key: Spark takes the cells to be as small as the table that they are exploded from, and would send them all to every executor."""
    tables = block_tables(max_bits, blocks)
    keys = F.array(*[(F.col("fp").bitwiseAND(F.lit(kept))) for kept, _ in tables])
    cells = nodes.select("fp", F.posexplode(keys).alias("t", "key"))
    x, y = cells.alias("x"), cells.alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(diff) <= max_bits)
    for i in range(max_bits):
        must = F.array(*[F.lit(m[i]) for _, m in tables])
        near = near & (F.element_at(must, F.col("x.t") + 1).bitwiseAND(diff) != 0)
    return (x.join(y.hint("merge"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & near)
            .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))


def named_components(prints: DataFrame, max_bits: int = 2, blocks: int = 8) -> DataFrame:
    """(fp, root, component_id) of every value ``fp`` of ``prints`` (doc_id, fp): the component's smallest value and doc_id."""
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(nodes, max_bits, blocks))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return settle(placed.join(lowest, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, blocks: int = 8,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document row; component_id is the smallest doc_id
    reachable over links of at most ``max_bits`` differing bits."""
    prints = settle(fingerprints(docs, shingle_words, id_col, text_col))
    return prints.join(named_components(prints, max_bits, blocks), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, null ids last, and of rows that
    repeat this id (or of null ids only) the first."""
    row, kept_row = free_name(docs.columns, "row"), free_name(docs.columns, "kept_row")
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    prints = settle(fingerprints(rows, shingle_words, id_col, text_col, row))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)
    kept = (prints.join(named_components(prints, max_bits).select("fp", "root"), "fp")
            .groupBy("root").agg(F.min(rank).alias("first")).select(F.col(f"first.{row}").alias(kept_row)))
    return rows.join(kept, F.col(row) == F.col(kept_row), "left_semi").drop(row)
