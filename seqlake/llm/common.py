"""Helpers shared by the training-data operators."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_ARROW_BATCH = 256   # whole texts travel in small batches: a batch of very long ones must fit a worker

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = ROWS_PER_ARROW_BATCH) -> None:
    """Lower the session's Arrow batch length (never raise it) before texts go to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside; the session's setting is restored."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str) -> DataFrame:
    """(doc_id long, text string): null texts become empty; every other column but ``carried`` is left out."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carried)


def same(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of all column pairs (usable as an equi-join condition)."""
    out = None
    for a, b in pairs:
        out = a.eqNullSafe(b) if out is None else out & a.eqNullSafe(b)
    return out


def counts_before(counts: DataFrame, key: str, block: str, n: str, name: str, bits: int = 12) -> DataFrame:
    """``counts`` (key, block, n; block a whole number) with the sum of ``n`` over the key's earlier blocks as ``name``.
    Sums run inside groups of 2**bits blocks and then over the groups, so a hot key is not one window."""
    group = F.shiftright(block, bits).alias("block_group")
    earlier = lambda by, order: F.coalesce(F.sum(n).over(
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy(key, group).agg(F.sum(n).alias(n)).withColumn("group_before", earlier([key], "block_group"))
    inside = counts.withColumn("block_group", group).withColumn("inside_before", earlier([key, "block_group"], block))
    return (inside.join(groups.select(F.col(key).alias("group_key"), F.col("block_group").alias("group_no"), "group_before"),
                        same((F.col(key), F.col("group_key")), (F.col("block_group"), F.col("group_no"))))
            .withColumn(name, F.col("inside_before") + F.col("group_before"))
            .drop("group_key", "group_no", "group_before", "inside_before", "block_group"))


def free_name(taken: list[str], name: str) -> str:
    """``name`` with as many underscores as it takes to be no name of ``taken`` (names differ by more than case)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name
