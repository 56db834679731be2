"""URL filters: Bloom filter cascade.

A url's keys are its host's suffixes joined with its path's prefixes (of the label counts and
lengths that listed keys have). The universe is every distinct key of the corpus. Level 1 of the
cascade encodes the listed keys; the universe's other keys that pass it by mistake are encoded by
level 2, the listed keys that pass level 2 by level 3, and so on until no mistake is left: then
membership is exact for every key of the universe, and looking it up needs no join. Levels are
built by grouping bit positions into words (partial OR first); the first level has about
``bits_per_key`` bits per listed key, and later ones a hundredth of the set before.

A level goes to the driver and, as a broadcast, to the executors; its size is known from the count of keys
before it is built. Lists whose level would be larger than ``max_level_bytes`` are divided by key hash into
as many shards, each with a cascade of its own, so that no single array passes the bound.

Defined results: null urls and urls without ``://`` have an empty host and path and no rule; an
empty list allows everything; an empty table gives an empty table; a key listed as both is a
block; repeated rows give repeated results; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import ASCII_LOWER, ASCII_UPPER
from seqlake.session import settle

BITS_PER_KEY = 10
MAX_LEVEL_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """(host, path) of a rule such as ``example.net/en/``."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def url_keys(host: str, path: str, labels: list[int], lengths: list[int]) -> list[str]:
    """The url's keys, longest first: host suffixes of the given label counts with path prefixes of the given lengths."""
    parts = host.split(".")
    hosts = [".".join(parts[-n:]) for n in labels if n <= len(parts)]
    return sorted((h + path[:n] for h in hosts for n in lengths if n <= len(path)), key=len, reverse=True)


def _positions(keys: Iterable[str], salt: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions, one row per key."""
    a = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace"), salt) for k in keys], dtype=np.uint64)
    low, high = a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(hashes, dtype=np.uint64) * high[:, None]) % np.uint64(bits)).astype(np.int64)


@dataclass
class Level:
    salt: int
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, keys: list[str]) -> np.ndarray:
        at = _positions(keys, self.salt, self.bits, self.hashes)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    shards: list[list[Level]]

    def __contains__(self, key: str) -> bool:
        return bool(self.has([key])[0])

    def has(self, keys: list[str]) -> np.ndarray:
        """Exact membership of keys of the universe."""
        out = np.zeros(len(keys), dtype=bool)
        shard = shard_of(keys, len(self.shards))
        for s, levels in enumerate(self.shards):
            left = np.flatnonzero(shard == s)
            for n, level in enumerate(levels):
                if not len(left):
                    break
                left = left[level.has([keys[i] for i in left])]
                out[left] = n % 2 == 0    # passed a level of listed keys: listed, unless the next one tells otherwise
        return out


def shard_of(keys: list[str], shards: int) -> np.ndarray:
    if shards == 1:
        return np.zeros(len(keys), dtype=np.int64)
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace"), 1) % shards for k in keys], dtype=np.int64)


def _level(spark: SparkSession, keys: DataFrame, n: int, salt: int, bits_per_key: int) -> Level:
    """A Bloom filter of the ``n`` rows of ``keys`` (key)."""
    bits = max(64, -(-n * bits_per_key // 64) * 64)
    hashes = max(1, round(math.log(2) * bits_per_key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(_positions(pdf["key"], salt, bits, hashes))
            word, first = np.unique(at >> 6, return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else at
            yield pd.DataFrame({"word": word, "value": values.view(np.int64)})

    rows = keys.mapInPandas(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value"))
    got = rows.toArrow().to_pandas()    # at most bits / 64 rows
    words = np.zeros(bits // 64, dtype=np.int64)
    words[got["word"].to_numpy(dtype=np.int64)] = got["value"].to_numpy(dtype=np.int64)
    return Level(salt, bits, hashes, words.view(np.uint64))


def build_cascade(universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_level_bytes: int = MAX_LEVEL_BYTES) -> Cascade:
    """The cascade of the listed keys of ``universe`` (key, listed), whose keys are distinct."""
    spark = universe.sparkSession
    listed, total = universe.agg(F.count_if("listed"), F.count("*")).first()
    shards = max(1, -(-max(listed, total // 100) * bits_per_key // 8 // max_level_bytes))
    return Cascade([_shard_levels(spark, universe, s, shards, bits_per_key) for s in range(shards)] if listed else [[]])


def _shard_levels(spark, universe: DataFrame, shard: int, shards: int, bits_per_key: int) -> list[Level]:
    mine = F.pandas_udf(lambda k: pd.Series(shard_of(k.tolist(), shards) == shard, dtype="bool"), "boolean")
    if shards > 1:
        universe = universe.where(mine("key"))
    encode, other, levels = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key"), []
    n = encode.count()
    while n:
        level = _level(spark, encode, n, 2 + len(levels), bits_per_key)
        levels.append(level)
        held = spark.sparkContext.broadcast(level)
        passes = F.pandas_udf(lambda k, held=held: pd.Series(held.value.has(k.tolist()), dtype="bool"), "boolean")
        encode, other = settle(other.where(passes("key"))), encode
        n = encode.count()
    return levels


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` under ``rules`` [(verdict, rule)].

    The longest rule that fits gives the verdict; without one the url's keys are not listed: ``default``."""
    spark = pages.sparkSession
    listed = {rule: "allow" for verdict, rule in rules if verdict == "allow"}
    listed |= {rule: "block" for verdict, rule in rules if verdict == "block"}
    parts = [split_rule(r) for r in listed]
    labels = sorted({h.count(".") + 1 for h, _ in parts})
    lengths = sorted({len(p) for _, p in parts})
    host, path = host_and_path(F.col(url_col).cast("string"))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": sorted({k for h, p in zip(pdf["host"], pdf["path"])
                                               for k in url_keys(h, p, labels, lengths)})}, dtype="str")

    table = spark.createDataFrame([("".join(split_rule(r)), v == "block") for r, v in listed.items()],
                                  "key string, block boolean")
    universe = settle(judged.select("host", "path").mapInPandas(keys_of, "key string")
                      .select("key", F.lit(False).alias("listed"), F.lit(False).alias("block"))
                      .unionByName(table.withColumn("listed", F.lit(True)))
                      .groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or("block").alias("block")))
    held = spark.sparkContext.broadcast((build_cascade(universe.select("key", "listed")),
                                         build_cascade(universe.select("key", F.col("block").alias("listed")))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, blocked = held.value
        for pdf in batches:
            keys = [url_keys(h, p, labels, lengths) for h, p in zip(pdf["host"], pdf["path"])]
            flat = [k for ks in keys for k in ks]
            owner = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys])
            hit = np.flatnonzero(known.has(flat))
            owners, first = np.unique(owner[hit], return_index=True)    # keys come longest first
            found = [flat[i] for i in hit[first]]
            rule, verdict = np.full(len(pdf), None, dtype=object), np.full(len(pdf), default, dtype=object)
            rule[owners] = found
            verdict[owners] = np.where(blocked.has(found), "block", "allow")
            yield pdf.assign(rule=rule, verdict=verdict)

    page_type = dict(judged.dtypes)["page_id"]
    return judged.mapInPandas(run, f"page_id {page_type}, host string, path string, rule string, verdict string")
