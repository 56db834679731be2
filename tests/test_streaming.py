import os
import tempfile

from seqlake.streaming.sequences import normalise_stream, read_shard_stream, write_stream


def test_stream_normalises_new_shards(spark):
    root = tempfile.mkdtemp(prefix="seqlake-stream-")
    src, out, ck = os.path.join(root, "src"), os.path.join(root, "out"), os.path.join(root, "ck")
    spark.createDataFrame([("a", "acgtXX"), ("b", "ＡＣGT")], "seq_id string, sequence string").write.parquet(src)
    q = write_stream(normalise_stream(read_shard_stream(spark, src)), out, ck)
    q.awaitTermination(120)
    got = {r.seq_id: r.sequence for r in spark.read.parquet(out).collect()}
    assert got == {"a": "ACGTNN", "b": "ACGT"}
