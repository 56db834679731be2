"""The stateless corpus operators (D1, D5, B4, R5) are plain column expressions and joins, so
they run unchanged on a streaming DataFrame. These helpers wire a parquet shard folder to a sink
with a checkpoint location (exactly-once file sink, restartable after executor or driver loss)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.dna import mask_unknown, normalise_dna
from seqlake.operators.bpe import BpeModel, encode_bpe
from seqlake.operators.species import match_names

SHARD_SCHEMA = T.StructType([T.StructField("seq_id", T.StringType()), T.StructField("sequence", T.StringType())])


def read_shard_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 16) -> DataFrame:
    """New parquet shards of one source folder as a stream (explicit schema, no inference)."""
    return (spark.readStream.schema(SHARD_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder).withColumn("file", F.col("_metadata.file_path")))


def normalise_stream(stream: DataFrame, model: BpeModel | None = None, vocab: DataFrame | None = None,
                     species_col: str | None = None) -> DataFrame:
    """D1 + D5 on every row; B4 token ids when a model is given; species ids (R5, stream-static
    joins of computed keys with the vocabulary's indexes) when a vocabulary and a name column are given."""
    out = stream.withColumn("sequence", mask_unknown(normalise_dna(F.col("sequence"))))
    if model is not None:
        out = encode_bpe(out, model)
    if vocab is not None and species_col:
        out = match_names(out, vocab, species_col)
    return out


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append to parquet with a checkpoint location; ``available_now`` processes what is there
    and stops (batch-like backfill), otherwise runs continuously."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
