"""Split CSV reading against Python's csv module, shard pruning by the files that are read, exact order statistics."""
import csv
import io as textio
import math
import random

import pytest
from pyspark.sql import functions as F

from seqlake.operators import order, sample
from seqlake.operators import taxonomy as T
from seqlake.sources import csv_split, io, shards


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that records go over their ends."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(rng):
    words = ["a", "NA", "", "x,y", 'say "hi"', "two\nlines", '"', "é", "nan", "l1\n\nl3", "long " * 30, "tail\n" * 90, " sp "]
    return [rng.choice(words) for _ in range(3)]


def test_split_reading_equals_the_csv_module(spark, small_splits, tmp_path):
    rng = random.Random(1)
    want = []
    for name in ("b", "a", "c"):
        text = textio.StringIO()
        w = csv.writer(text, lineterminator="\n")
        w.writerow(["id", "one two", "x"])
        rows = [[f"{name}{i}", *cells(rng)[:2]] for i in range(120)]
        w.writerows(rows)
        raw = text.getvalue()
        if name == "a":
            raw = raw.replace("\na7,", "\n\n\na7,") + "\n"            # empty lines are no records
        (tmp_path / f"{name}.csv").write_bytes(raw.encode())
        want.append((name, rows))
    df = csv_split.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "one two", "x", csv_split.ROW]
    got = sorted(df.collect(), key=lambda r: r[3])
    rows = [r for _, rs in sorted(want) for r in rs]
    assert [r[3] for r in got] == list(range(360))
    # Spark reads an empty cell as null and trims nothing else
    assert [[c or "" for c in r[:3]] for r in got] == rows
    lines = csv_split._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    starts, files = csv_split.split_starts(spark, str(tmp_path))
    assert len(starts) > 20 and any(state for state, _ in starts.values()) and len(files) == 3


def test_task_tables_number_rows_and_know_na(spark, small_splits, tmp_path):
    (tmp_path / "t.csv").write_bytes(("sequence,label\r\n" + "".join(f'"AC\nGT{i}",{"NA" if i % 5 == 0 else i}\r\n' for i in range(200))).encode())
    rows = io.read_task_table(spark, str(tmp_path / "t.csv")).orderBy("row_id").collect()
    assert [(r.row_id, r.sequence, r.label) for r in rows] == [(i, f"AC\nGT{i}", None if i % 5 == 0 else str(i)) for i in range(200)]
    (tmp_path / "h.csv").write_bytes(b"a,,a\n")
    assert io.read_metadata(spark, str(tmp_path / "h.csv")).columns == ["a0", "_c1", "a2"]
    assert io.read_metadata(spark, str(tmp_path / "h.csv")).count() == 0


@pytest.fixture
def shard_root(spark, tmp_path):
    for source in ("fungi", "virus"):
        for k in range(6):
            rows = [(f"{source[0]}{k}_{i}", f"ACGT{k}{i}") for i in range(50)] + [(f"{source[0]}dup", f"D{k}")] * (2 if k in (2, 4) else 0)
            spark.createDataFrame(rows, "seq_id string, sequence string").coalesce(1).write.parquet(str(tmp_path / source / f"p{k}"))
            part = next((tmp_path / source / f"p{k}").glob("*.parquet"))
            part.rename(tmp_path / source / f"shard-{k}.parquet")
    for source in ("fungi", "virus"):      # the writers' folders hold no rows any more
        for k in range(6):
            for f in (tmp_path / source / f"p{k}").iterdir():
                f.unlink()
            (tmp_path / source / f"p{k}").rmdir()
    return str(tmp_path)


def test_unlisted_shards_are_not_read(spark, shard_root):
    rows = io.read_sequence_shards(spark, shard_root, ["fungi", "virus"])
    assert rows.count() == 2 * (300 + 4) and {r.source for r in rows.select("source").distinct().collect()} == {"fungi", "virus"}
    index = shards.build_index(rows).cache()
    assert index.count() == 12
    ids = spark.createDataFrame([("fungi", "f1_3"), ("fungi", "f1_4"), ("fungi", "fdup"), ("virus", "v5_0"), ("virus", "f1_3"), ("none", "x")],
                                "source string, seq_id string")
    files = [f.rsplit("/", 2)[1:] for f in shards.candidate_files(ids, index)]
    assert {("fungi", "shard-1.parquet"), ("fungi", "shard-2.parquet"), ("fungi", "shard-4.parquet"), ("virus", "shard-5.parquet")} <= {tuple(f) for f in files}
    assert len(files) <= 6
    got = shards.select_from_shards(spark, ids, index)
    plain = sample.select_sequences(ids, rows)
    key = lambda r: (r.source, r.file, r.seq_id, r.sequence)
    want = sorted(map(key, plain.select("source", "file", "seq_id", "sequence").collect()))
    assert sorted(map(key, got.collect())) == want and len(want) == 5      # of fdup the two rows of the first shard that has it
    assert shards.select_from_shards(spark, ids.where("source = 'none'"), index).count() == 0


def test_order_statistics_are_exact(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1e-300, -1e300, 5e-324, math.inf, -math.inf, 3.0, 3.0, 3.0] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9) for _ in range(400)]
    rows = [(g, v) for g in ("a", None) for v in values if g or v > 0] + [("one", 7.5), ("null", None), ("nan", math.nan), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = order.order_statistics(df, ["g"], F.col("v"), {"first": F.lit(0), "low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2), "last": F.col("n") - 1})
    got = {r.g: tuple(r)[1:] for r in got.collect()}
    for g in ("a", None, "one", "nan"):
        v = sorted(x for h, x in rows if h == g and x is not None and x == x)
        assert got[g] == (len(v), v[0], v[(len(v) - 1) // 2], v[len(v) // 2], v[-1])
    assert "null" not in got and len(got) == 4


def test_medians(spark):
    df = spark.createDataFrame([("a", "x" * n) for n in (1, 4, 9, 20)] + [("b", "x" * n) for n in (3, 5, 100)] + [("c", None)], "g string, sequence string")
    assert {r.g: r.median_len for r in sample.length_median(df, ["g"]).collect()} == {"a": 6, "b": 5}
    table = spark.createDataFrame([("p", [3.0, 4.0]), ("q", [1.0, 0.0]), ("q", [0.0, 2.0]), ("r", [0.0, 0.5])], "name string, vec array<double>")
    assert tuple(T.norm_stats(table).first()) == (3, 0.5, 1.0, 5.0)
    assert tuple(T.norm_stats(table.limit(0)).first()) == (0, None, None, None)
