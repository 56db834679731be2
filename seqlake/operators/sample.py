"""Sampling, selection and corpus statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.hashing import hash_int, seeded_hash
from seqlake.operators.index import row_index
from seqlake.operators.order import order_statistics
from seqlake.session import settle


def sample_per_group(df: DataFrame, group: str, id_col: str, n: int = 1, seed: int = 42) -> DataFrame:
    """``n`` rows per group (the empty group included) in seeded order.

    ``row_number() <= n`` becomes a WindowGroupLimit that also runs before the shuffle, so a hot
    group ships at most ``n`` rows per input partition.
    """
    w = Window.partitionBy(group).orderBy(seeded_hash(id_col, seed), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, name: str = "pos", cheap: bool = False) -> DataFrame:
    """The whole table in seeded random order, with a dense 0-based position (``cheap``: see :func:`row_index`)."""
    return row_index(df.withColumn("_h", seeded_hash(id_col, seed)), ["_h", id_col], name, cheap=cheap).drop("_h")


def select_sequences(ids: DataFrame, shards: DataFrame) -> DataFrame:
    """Shard rows whose ``(source, seq_id)`` is listed in ``ids``.

    Per id the first shard (smallest ``file``) holding it wins and all its rows in that shard stay;
    ids absent from every shard drop out (see :func:`missing_ids`). The shards are scanned once: the listed rows
    are written as a table, from which the first shard of every id is found. With a shard index,
    :func:`seqlake.sources.shards.select_from_shards` reads only the shards that may hold listed ids.
    """
    wanted = ids.select("source", "seq_id").distinct()
    hits = settle(shards.join(wanted, ["source", "seq_id"], "left_semi"))
    first = hits.groupBy("source", "seq_id").agg(F.min("file").alias("file"))
    return hits.join(first, ["source", "seq_id", "file"], "left_semi")


def missing_ids(ids: DataFrame, shards: DataFrame) -> DataFrame:
    """C4: listed ids found in no shard of their source."""
    return ids.select("source", "seq_id").distinct().join(
        shards.select("source", "seq_id"), ["source", "seq_id"], "left_anti")


def random_crop(df: DataFrame, col: str, id_col: str, max_len: int = 100_000, seed: int = 42,
                start_col: str | None = None) -> DataFrame:
    """Sequences longer than ``max_len`` keep one window of ``max_len`` characters whose start
    is seeded-uniform in ``[0, len - max_len]`` (inclusive)."""
    length = F.length(col)
    start = F.when(length > max_len, F.pmod(hash_int(id_col, seed), length - max_len + 1)).otherwise(0)
    out = df.withColumn("_start", start).withColumn(
        col, F.when(length > max_len, F.substring(F.col(col), F.col("_start") + 1, max_len)).otherwise(F.col(col)))
    return out.withColumnRenamed("_start", start_col) if start_col else out.drop("_start")


def corpus_stats(df: DataFrame, by: list[str], seq_col: str = "sequence", id_col: str = "seq_id") -> DataFrame:
    """Sequence count, distinct ids and total length per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.countDistinct(id_col).alias("n_ids"),
        F.sum(F.length(seq_col)).cast("bigint").alias("total_bp"))


def length_median(df: DataFrame, by: list[str], seq_col: str = "sequence") -> DataFrame:
    """Median length of every group (the mean of the two middle ones, truncated to an integer), exact at any size."""
    middle = {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}
    out = order_statistics(df, by, F.length(seq_col), middle)
    return out.select(*by, ((F.col("low") + F.col("high")) / 2).cast("bigint").alias("median_len"))


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels over all splits."""
    return df.agg(F.countDistinct(label).alias("n_classes"))
