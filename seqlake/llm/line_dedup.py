"""Substring dedup: line or paragraph hashing.

Texts are cut into units: lines, and inside lines sentences, so that a passage set into the middle
of a line is found as well. A unit begins after a line break, after white space that follows ``.``, ``!`` or ``?``,
and at a capital (A-Z or Latin-1) after white space; it ends where the next one begins. Units are normalised
(A-Z lower-cased, white space collapsed) and hashed to 64 bits. Digests are grouped globally with a partial
minimum, which keeps the earliest occurrence by (doc_id, hash of the text, position), so a unit that
a third of all documents share costs one row per task there. Later occurrences are told to their documents by a join on
the digest; digests with so many rows that their key would be a hot one are broadcast (``FEW_HOT`` bounds how many).

A run of consecutive later occurrences is a repeated passage and is cut, with its code-point offsets in the original
text retained, if it has ``min_words`` words or ``min_bytes`` bytes (normalised, UTF-8: a text without blanks has length
too) and at least half of its bytes lie in units of ``CLEAR_BYTES`` or more, which do not recur by chance. A
shorter run stays: a heading, a licence line, a single sentence in common is no passage. The same rule holds at any size of corpus.

Defined results: a null or empty text has no units and stays (null becomes empty); a null doc_id
ranks last; rows that repeat both doc_id and text are one document and get the same result; an
empty table gives an empty table; other columns are carried unchanged, whatever their names: the column of the spans
is ``removed_spans``, with underscores added while the table has such a column.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import free_name, same
from seqlake.llm.ragged import byte_slices, offsets_of, text_buffer
from seqlake.session import settle

MIN_WORDS, MIN_BYTES = 30, 300    # of a repeated passage
CLEAR_BYTES = 16                  # of a unit that does not recur by chance
HOT_ROWS, FEW_HOT = 1_000, 100_000    # a digest is hot from HOT_ROWS rows on, and from a FEW_HOT-th of all rows on
SLICE_BYTES = 1 << 20             # of text cut together: some numbers are kept for every byte
SPANS = "array<struct<start:bigint,end:bigint>>"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(9, 14)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Units:
    """The units of texts that lie one after the other in a buffer: where they begin and end, their normal forms, sizes and words."""

    def __init__(self, data: np.ndarray, doc_at: np.ndarray):
        n, blank = len(data), _BLANK[data]
        before = np.r_[True, blank[:-1]]                       # the byte before is white space
        follow = np.r_[data[1:], np.uint8(0)]
        capital = (data >= 0x41) & (data <= 0x5A) | (data == 0xC3) & (follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)
        stop = np.r_[False, False, _STOP[data[:-2]]][:n]       # two bytes before
        second = doc_at[:-1] + 1
        stop[second[second < n]] = False
        begins = ~blank & before & (capital | stop | np.r_[False, data[:-1] == 10][:n])
        first = doc_at[:-1][doc_at[:-1] < doc_at[1:]]          # of texts that are not empty
        begins[first] = True
        self.begin = np.flatnonzero(begins)
        self.end = np.r_[self.begin[1:], n].astype(np.int64)
        self.at = np.searchsorted(self.begin, doc_at)          # units of text d: at[d] .. at[d + 1]
        # a blank stays, as one, between two words of a unit
        solid = np.flatnonzero(~blank)
        keep = ~blank
        inner = solid[1:][np.diff(solid) > 1]                  # begins a word after white space
        owner = np.searchsorted(self.begin, solid, side="right")
        inner = inner[owner[1:][np.diff(solid) > 1] == owner[:-1][np.diff(solid) > 1]]
        keep[inner - 1] = True
        plain = np.where(blank, np.uint8(0x20), _LOWER[data])[keep]
        place = offsets_of(keep)
        low, high = place[self.begin], place[self.end]
        self.size = high - low
        starts = offsets_of(~blank & (before | begins))
        self.words = starts[self.end] - starts[self.begin]
        raw = plain.tobytes()
        digest = xxhash.xxh64_intdigest
        self.digest = np.fromiter((digest(raw[a:b]) for a, b in zip(low.tolist(), high.tolist())), dtype=np.uint64, count=len(low)).view(np.int64)
        self.points = offsets_of((data & 0xC0) != 0x80)        # code points before a byte

    def passages(self, d: int, later: np.ndarray, min_words: int, min_bytes: int) -> list[tuple[int, int]]:
        """(first unit, last unit) of the runs of text ``d`` that go, counted within the text; ``later`` lists its later occurrences."""
        out, lo = [], self.at[d]
        later = np.unique(later)
        edge = np.flatnonzero(np.diff(later) != 1) + 1
        for a, b in zip(np.r_[0, edge], np.r_[edge, len(later)]):
            run = slice(lo + later[a], lo + later[b - 1] + 1)
            size = self.size[run]
            if ((self.words[run].sum() >= min_words or size.sum() >= min_bytes) and 2 * size[size >= CLEAR_BYTES].sum() >= size.sum()):
                out.append((int(later[a]), int(later[b - 1])))
        return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, digests) of every text with a unit; ``docs`` has doc_id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", SLICE_BYTES):
            units = Units(*text_buffer(part.column("text").combine_chunks()))
            yield pa.record_batch({"doc_id": part.column("doc_id").combine_chunks(), "text_hash": part.column("text_hash").combine_chunks(),
                                   "digests": pa.ListArray.from_arrays(pa.array(units.at, pa.int32()), pa.array(units.digest))})

    plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.col("text") != "")
    return plain.mapInArrow(run, "doc_id bigint, text_hash bigint, digests array<bigint>")


def later_units(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, later): per document the positions of units that occur earlier."""
    rows = found.select("doc_id", "text_hash", F.posexplode("digests").alias("pos", "digest"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos")
    first = settle(rows.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("final"), F.count("*").alias("n"))
                   .where("first <> final").select("digest", "first", "n"))
    total = found.agg(F.sum(F.size("digests"))).first()[0] or 0
    hot = first.where(F.col("n") >= max(HOT_ROWS, total // FEW_HOT)).select("digest", "first")     # at most FEW_HOT rows
    rest = first.where(F.col("n") < max(HOT_ROWS, total // FEW_HOT)).select("digest", "first")
    cool = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    again = (rows.join(F.broadcast(hot), "digest").unionByName(cool.join(rest, "digest"))).where(rank != F.col("first"))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("later"))


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from its texts by the rule above, and, as the last column, the spans
    array<struct<start,end>> that were cut from the original text."""
    doc_id, text = F.col(f"`{id_col}`").cast("bigint"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = settle(digests(docs.select(doc_id.alias("doc_id"), text.alias("text"))))
    spans = free_name(docs.columns, "removed_spans")
    key_id, key_hash, positions = (free_name([*docs.columns, spans], c) for c in ("cut_id", "cut_hash", "cut_units"))
    cuts = later_units(found).toDF(key_id, key_hash, positions)
    joined = docs.join(cuts, same((doc_id, F.col(key_id)), (F.xxhash64(text), F.col(key_hash))), "left")
    joined = joined.select(*((text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns), positions)
    place = docs.columns.index(text_col)
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(spans, T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for part in byte_slices(batches, text_col, SLICE_BYTES) for b in part.combine_chunks().to_batches()):
            later = batch.column(batch.num_columns - 1)
            texts = batch.column(place)
            hit = np.flatnonzero(later.is_valid())
            cut: list = [[] for _ in range(batch.num_rows)]
            if len(hit):
                some = texts.take(pa.array(hit))
                data, doc_at = text_buffer(some)
                units, raw, whole = Units(data, doc_at), data.tobytes(), texts.to_pylist()
                for d, i in enumerate(hit.tolist()):
                    gone = units.passages(d, np.array(later[i].as_py(), dtype=np.int64), min_words, min_bytes)
                    here, kept = doc_at[d], []
                    for a, b in gone:
                        begin, end = units.begin[units.at[d] + a], units.end[units.at[d] + b]
                        kept.append(raw[here:begin])
                        here = end
                        zero = units.points[doc_at[d]]
                        cut[i].append({"start": int(units.points[begin] - zero), "end": int(units.points[end] - zero)})
                    if gone:
                        whole[i] = (b"".join(kept) + raw[here:doc_at[d + 1]]).decode("utf-8", "replace")
                texts = pa.array(whole, pa.string())
            columns = batch.columns[:-1]
            columns[place] = texts.cast(pa.string())
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, spans_type)], names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)
