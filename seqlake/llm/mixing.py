"""Mixing sources to target weights.

The words of each source are laid end to end (documents in a fixed pseudorandom order) and cut
into fixed-length blocks. The mix is a row of slots, dealt over output shards. How many slots of a
shard each source gets is a multinomial draw; the draws are made down a binary tree over the
shards, so that every shard finds its own counts (and how many slots of a source lie before it)
without looking at other shards, and the totals come out at the targets. Slot ``j`` of a source is
in pass ``j div blocks`` and takes the block at place ``j mod blocks`` of that pass's
pseudorandom permutation of the source's block numbers. Blocks and slots are joined by number.

Nothing is sorted or summed over a whole source in one task: running totals are made inside small
hash buckets and between them. Only the table of sources (one row each) visits the driver.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of
its own, last in order; repeated rows are separate documents; sources without any word have
target 0; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import free_name, same, small_batches
from seqlake.session import settle

WORD = re.compile("[^\x20\x09-\x0d]+")
SLOTS_PER_SHARD = 1 << 15
DOCS_PER_BUCKET = 512


@dataclass
class Source:
    name: str | None
    size: int
    target: float = 0.0


def word_count(text: pd.Series) -> pd.Series:
    return pd.Series([len(t.encode("utf-8", "replace").split()) for t in text], dtype="int64")


def sizes(docs: DataFrame, rid: str) -> DataFrame:
    """(rid, doc_id, source, size): the number of words of every row of ``docs``; ``rid`` names its unique row number."""
    small_batches(docs.sparkSession)
    count = F.pandas_udf(word_count, "bigint")
    return docs.select(F.col(rid).alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("source").cast("string").alias("source"),
                       count(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("size"))


def take_words(text: str, ranges: list[tuple[int, int]], size: int) -> str:
    """The words of ``text`` in the ascending ranges of word numbers; the text itself if these are all its words."""
    joined: list[list[int]] = []
    for a, b in ranges:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    if joined == [[0, size]]:
        return text
    spans = [w.span() for w in WORD.finditer(text)]
    return "\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in joined)


def targets(found: list[Source], weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> list[Source]:
    """The sources by code point (null last) with their targets: ``share`` of all words by repeating weights;
    what exceeds ``limit`` times a source's size is shared again among the others by weight."""
    ordered = sorted(found, key=lambda s: (s.name is None, s.name or ""))
    weight = {i: weights[i % len(weights)] for i in range(len(ordered))}
    left, free = share * sum(s.size for s in ordered), set(weight)
    while free:
        unit = left / sum(weight[i] for i in free)
        over = {i for i in free if weight[i] * unit > limit * ordered[i].size}
        for i in over or free:
            ordered[i].target = limit * ordered[i].size if over else weight[i] * unit
        if not over:
            break
        left -= sum(ordered[i].target for i in over)
        free -= over
    return ordered


def draw(totals: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of ``n`` slots over sources with ``totals`` slots left, none above its total."""
    got = np.zeros_like(totals)
    while (need := n - int(got.sum())) > 0:
        room = totals - got
        got = np.minimum(totals, got + rng.multinomial(need, room / room.sum()))
    return got


def shard_counts(shard: int, shards: int, per_shard: int, totals: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it)."""
    first, last, before = 0, shards, np.zeros_like(totals)
    while last - first > 1:
        mid = (first + last) // 2
        left = draw(totals, (mid - first) * per_shard, np.random.default_rng([seed, first, last]))
        if shard < mid:
            last, totals = mid, left
        else:
            first, before, totals = mid, before + left, totals - left
    return before, totals


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    z = x + np.uint64(key)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted(places: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The images of ``places`` under a pseudorandom permutation of 0..n-1: a four-round Feistel
    network over the next even number of bits, applied again while the image is n or more."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = places.astype(np.uint64), np.arange(len(places))
    while len(todo):
        x = out[todo]
        a, b = x >> half, x & low
        for key in keys:
            a, b = b, a ^ (_mixed(b, int(key)) & low)
        out[todo] = a << half | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(spark, blocks: np.ndarray, wanted: np.ndarray, seed: int, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(source_no, block, pass, shard, slot): ``wanted[s]`` slots over the ``blocks[s]`` blocks of source s."""
    total = int(wanted.sum())
    shards = -(-total // per_shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                before, here = shard_counts(int(shard), shards, per_shard, wanted, seed)
                at = 0
                order = np.random.default_rng([seed, int(shard), shards, 1]).permutation(int(here.sum()))
                for s in np.flatnonzero(here):
                    j = before[s] + np.arange(here[s])
                    turn, place = np.divmod(j, blocks[s])
                    block = np.empty_like(j)
                    for t in np.unique(turn):
                        keys = np.random.default_rng([seed, int(s), int(t), 2]).integers(0, 1 << 63, 4)
                        block[turn == t] = permuted(place[turn == t], int(blocks[s]), keys)
                    yield pd.DataFrame({"source_no": np.int32(s), "block": block, "pass": turn.astype(np.int32),
                                        "shard": shard, "slot": order[at:at + here[s]]})
                    at += int(here[s])

    ids = spark.range(0, shards, 1, max(1, min(shards, 10_000)))
    return ids.mapInPandas(run, "source_no int, block bigint, pass int, shard bigint, slot bigint")


@dataclass
class Mix:
    sources: DataFrame    # source_no, source, source_size, target
    documents: DataFrame  # rid, doc_id, source_no, size, start (of its words in the source)
    pieces: DataFrame     # rid, doc_id, source_no, size, start, block, first, last (words of the source; null: none)
    slots: DataFrame      # source_no, block, pass, shard, slot


def mix(sized: DataFrame, block_words: int = 32, weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
        seed: int = 42) -> Mix:
    """Mix the documents ``sized`` (rid unique, doc_id, source, size)."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    plan = targets([Source(r["source"], r["size"]) for r in totals], weights, share, limit)
    size, target = (np.array([getattr(s, k) for s in plan], dtype=float) for k in ("size", "target"))
    blocks = -(-size.astype(np.int64) // block_words)
    wanted = np.rint(np.divide(target * blocks, size, out=np.zeros_like(size), where=size > 0)).astype(np.int64)
    sources = spark.createDataFrame([(i, s.name, s.size, float(s.target)) for i, s in enumerate(plan)],
                                    "source_no int, source string, source_size bigint, target double")
    buckets = 1 + sum(r["n"] for r in totals) // DOCS_PER_BUCKET
    numbered = (sized.join(sources.select("source_no", F.col("source").alias("__name")),
                           same((F.col("source"), F.col("__name"))))
                .select("rid", "doc_id", "source_no", "size",
                        F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket")))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    offsets = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(
        earlier.partitionBy("source_no").orderBy("bucket")), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("size").over(earlier.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "rid")), F.lit(0))
    laid = (numbered.withColumn("inside", inside).join(offsets, ["source_no", "bucket"])
            .select("rid", "doc_id", "source_no", "size", (F.col("offset") + F.col("inside")).alias("start")))
    end = F.col("start") + F.col("size")
    touched = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"),
                                                   F.expr(f"(start + size - 1) div {block_words}")))
    pieces = (laid.select("*", F.explode_outer(touched).alias("block"))
              .withColumn("first", F.greatest("start", F.col("block") * block_words))
              .withColumn("last", F.least(end, (F.col("block") + 1) * block_words)))
    return Mix(sources, laid, pieces, slots(spark, blocks, wanted, seed))


def taken_words(m: Mix) -> DataFrame:
    """(rid, doc_id, source_no, size, taken): the words the mix takes of each document, repeats counted."""
    takes = m.slots.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")   # as long as the corpus
    return (m.pieces.join(takes, ["source_no", "block"], "left")
            .groupBy("rid", "doc_id", "source_no", "size")
            .agg(F.coalesce(F.sum((F.col("last") - F.col("first")) * F.col("times")), F.lit(0)).alias("taken")))


def mixed_documents(docs: DataFrame, block_words: int = 32, weights: tuple = (3, 1, 2), share: float = 1.5,
                    limit: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix as documents: per row and pass, the row with the words that pass takes, in order.

    A row whose words are all taken twice comes twice, unchanged; a row of which a pass takes a
    part comes with that part; a row that no pass takes is left out. ``n_chars``, if there, is the new length.
    """
    rid, part_rid, pass_, size_, parts_, text_ = (free_name(docs.columns, c) for c in ("rid", "part_rid", "pass", "part_size", "parts", "part_text"))
    numbered = settle(docs.withColumn(rid, F.monotonically_increasing_id()))
    m = mix(settle(sizes(numbered, rid)), block_words, weights, share, limit, seed)
    word = F.struct((F.col("first") - F.col("start")).alias("a"), (F.col("last") - F.col("start")).alias("b"))
    parts = (m.pieces.join(m.slots.select("source_no", "block", "pass").hint("merge"), ["source_no", "block"])
             .groupBy(F.col("rid").alias(part_rid), F.col("pass").alias(pass_), F.col("size").alias(size_))
             .agg(F.array_sort(F.collect_list(word)).alias(parts_)))

    @F.pandas_udf("string")
    def part_text(text: pd.Series, parts: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([take_words(t, [(p["a"], p["b"]) for p in ps], n)
                          for t, ps, n in zip(text, parts, size)], dtype=object)

    joined = (numbered.join(parts, F.col(rid) == F.col(part_rid))
              .withColumn(text_, part_text("text", parts_, size_)))
    as_type = dict(docs.dtypes)
    new = {"text": F.col(text_)}
    if "n_chars" in as_type:
        new["n_chars"] = F.length(text_).cast(as_type["n_chars"])
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
