"""An index over sequence shards, so that shards without listed ids are not read.

For every shard file the index has its source, the range of its ids and a Bloom filter of them (about
ten bits an id, five hashes). Listed ids, in chunks, meet the index rows of their source; a shard is read if one of
its ids may be listed. False positives only cost the reading of a shard: the rows are joined with the list.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.sample import select_sequences

BITS_PER_ID, HASHES = 10, 5
CHUNK_IDS = 100_000       # listed ids that meet an index row at a time
INDEX_SCHEMA = "source string, file string, n bigint, low string, high string, bits binary"


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, file, seq_id, sequence) of shard files or folders ``<root>/<source>``; the source is a file's folder."""
    rows = spark.read.parquet(*paths)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("source"), F.col("_metadata.file_path").alias("file"),
                       F.col("seq_id").cast("string").alias("seq_id"), "sequence")


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """HASHES bit places for every 64-bit hash."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)


def build_index(shards: DataFrame) -> DataFrame:
    """One row per shard file of ``shards`` (source, file, seq_id, ..)."""
    def run(key, table):
        hashes, ids = np.asarray(table.column("hash")), table.column("seq_id").to_pylist()
        size = max(64, 8 * -(-BITS_PER_ID * len(ids) // 8))
        bits = np.zeros(size, dtype=bool)
        bits[_places(hashes, size).ravel().astype(np.int64)] = True
        return pa.table({"source": [key[0].as_py()], "file": [key[1].as_py()], "n": [len(ids)], "low": [min(ids)], "high": [max(ids)],
                         "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = shards.select("source", "file", F.col("seq_id").cast("string").alias("seq_id")).where("seq_id is not null").distinct()
    return rows.withColumn("hash", F.xxhash64("seq_id")).groupBy("source", "file").applyInArrow(run, INDEX_SCHEMA)


def candidate_files(ids: DataFrame, index: DataFrame) -> list[str]:
    """The shard files that may hold one of ``ids`` (source, seq_id)."""
    chunk = F.pmod(F.xxhash64("seq_id"), F.lit(1 + ids.count() // CHUNK_IDS))
    asked = (ids.select("source", F.col("seq_id").cast("string").alias("seq_id")).distinct().groupBy("source", chunk.alias("chunk"))
             .agg(F.collect_list("seq_id").alias("ids"), F.collect_list(F.xxhash64("seq_id")).alias("hashes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
                inside = np.array([r["low"] <= i <= r["high"] for i in r["ids"]])
                hit = bits[_places(np.array(r["hashes"], dtype=np.int64)[inside], len(bits)).astype(np.int64)].all(axis=1)
                if hit.any():
                    keep.append(r["file"])
            yield pa.record_batch({"file": pa.array(keep, pa.string())})

    met = index.join(asked, "source").select("file", "low", "high", "bits", "ids", "hashes").mapInArrow(run, "file string")
    return sorted(r["file"] for r in met.distinct().collect())        # at most a row per shard


def select_from_shards(spark: SparkSession, ids: DataFrame, index: DataFrame) -> DataFrame:
    """C3 over indexed shards: as :func:`seqlake.operators.sample.select_sequences`, reading only shards that may hold listed ids."""
    files = candidate_files(ids, index)
    if not files:
        return spark.createDataFrame([], "source string, file string, seq_id string, sequence string")
    listed = ids.select("source", F.col("seq_id").cast("string").alias("seq_id"))
    return select_sequences(listed, read_shards(spark, files)).select("source", "file", "seq_id", "sequence")
