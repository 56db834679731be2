"""CSV files read by many tasks, quoted line breaks included.

A line of a CSV file begins a record unless it lies inside quotes, and whether it does depends on all
quotes before it. So the files are read as lines, in splits as Spark makes them, and twice: first every split
counts its quotes and, for either state it may begin in, the records that begin in it; the running parity of the quotes,
and the running number of records, over the splits of a file give every split its beginning (a row per
split passes through the driver, which lists the splits anyway). Then every split cuts its lines into records; only
those that go over a split's end, at most one a split, are put together by a shuffle. Spark parses the records.

Records are numbered through the files in path order, so a row's number is its place in the table. The
first record of a file is its header; names come from the first file. Empty lines are no records. A quote
inside an unquoted cell is beyond what this (or any splittable) reading can tell from a quoted one.
"""
from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "row_no"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, split, lines) of the consecutive rows of one split in a batch."""
    file, at = batch.column("file").dictionary_encode(), np.asarray(batch.column("at"))
    code = np.asarray(file.indices)
    edge = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])]) if len(at) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)]):
        yield file.dictionary[int(code[a])].as_py(), int(at[a]), batch.column("value").slice(a, b - a)


def _quotes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(quotes before every line modulo 2, empty lines)."""
    n = np.asarray(pc.count_substring(lines, '"'), dtype=np.int64)
    return (np.cumsum(n) - n) & 1, np.asarray(pc.is_in(lines, value_set=pa.array(["", "\r"], lines.type)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, at, lines in _runs(batch):
            state = found.setdefault((file, at), [0, 0, 0])     # parity, records if it begins outside quotes, inside
            before, empty = _quotes(lines)
            before ^= state[0]
            state[1] += int(((before == 0) & ~empty).sum())
            state[2] += int(((before == 1) & ~empty).sum())
            state[0] = int(before[-1] ^ (lines[-1].as_py().count('"') & 1))
    rows = [(f, a, *s) for (f, a), s in found.items()]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                          names=["file", "at", "parity", "outside", "inside"])


def split_starts(spark: SparkSession, path: str) -> tuple[dict[tuple[str, int], tuple[int, int]], dict[str, int]]:
    """({(file, split): (state it begins in, number of its first record)}, {file: number of its first record})."""
    rows = _lines(spark, path).mapInArrow(_count, "file string, at bigint, parity bigint, outside bigint, inside bigint").collect()
    starts, files, number, last, state = {}, {}, 0, None, 0
    for r in sorted(rows, key=lambda r: (r["file"], r["at"])):
        if r["file"] != last:
            last, state = r["file"], 0
            files[last] = number
        starts[r["file"], r["at"]] = (state, number)
        number += r["inside"] if state else r["outside"]
        state ^= r["parity"]
    return starts, files


def _records(starts):
    """Pieces of records: (file, number, place of the piece, text); ``place`` orders the pieces of one record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number, held = None, 0, -1, []

        def flush():
            """The piece that is open; its place is the split, so a record's pieces sort by where they were read."""
            if now is not None and held:
                out.append((now[0], number, now[1], "\n".join(held)))
                held.clear()

        for batch in batches:
            out: list[tuple] = []
            for file, at, lines in _runs(batch):
                if (file, at) != now:
                    flush()
                    now = (file, at)
                    state, number = starts.value[now]
                    number -= 1                                # the record that an earlier split left open, if any
                before, empty = _quotes(lines)
                before ^= state
                for line, inside, blank in zip(lines.to_pylist(), before.tolist(), empty.tolist()):
                    if inside:
                        held.append(line)
                    elif not blank:
                        flush()
                        number += 1
                        held.append(line)
                state = int(before[-1] ^ (lines[-1].as_py().count('"') & 1))
            if out:
                yield _table(out)
        out = []
        flush()
        if out:
            yield _table(out)

    def _table(rows):
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                               names=["file", "number", "place", "text"])
    return run


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The table as strings, with the number of every row (0, 1, .. through the files) as the last column, ``ROW``."""
    starts, files = split_starts(spark, path)
    shared = spark.sparkContext.broadcast(starts)
    pieces = _lines(spark, path).mapInArrow(_records(shared), "file string, number bigint, place bigint, text string")
    # a record goes over a split's end if the next split begins inside quotes: the last one of a split, the one before the next's first
    over = sorted({number - 1 for state, number in starts.values() if state})
    table = spark.createDataFrame([(n,) for n in over], "number bigint")
    whole = pieces.join(table, "number", "left_anti").select("file", "number", "text")
    broken = (pieces.join(table, "number").groupBy("file", "number")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "\n").alias("text")))
    records = whole.unionByName(broken.select("file", "number", "text")).withColumn("text", F.regexp_replace("text", "\r$", ""))
    heads = list(files.values())
    if not heads:
        return spark.createDataFrame([], T.StructType([T.StructField(ROW, T.LongType())]))
    header = records.where(F.col("number") == heads[0]).select("text").first()
    names = _names(next(csv.reader(io.StringIO(header["text"])))) if header else []
    later = F.lit(0)
    for n in heads:                                            # rows after a file's header are one less for every header before
        later = later + (F.col("number") > n).cast("bigint")
    cells = F.from_csv("text", _ddl(names), {"escape": '"'})
    return (records.where(~F.col("number").isin(heads)).select((F.col("number") - later).alias(ROW), cells.alias("cells"))
            .select(*[F.col("cells").getField(c).alias(c) for c in names], ROW))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in names)


def _names(cells: list[str]) -> list[str]:
    """Column names of a header: empty ones are numbered, repeated ones get their number."""
    out = [c or f"_c{i}" for i, c in enumerate(cells)]
    return [f"{c}{i}" if [x.lower() for x in out].count(c.lower()) > 1 else c for i, c in enumerate(out)]
