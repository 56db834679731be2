"""Best-fit packing: large-item matching.

Every document becomes its token ids plus one end id; only documents longer than a sequence are
cut, into full pieces with the short remainder first. How pieces combine depends on their lengths
alone, so the plan is made on the table of (length, how many): at most ``capacity`` rows whatever
the corpus size. Lengths above a third of the capacity are matched greedily, at most two to a
sequence (longest first, each with the longest partner that still fits); the shorter lengths,
longest first, go to the fullest sequences that can still take them. The plan is kept as runs of
equal sequences. Each piece then finds its place from its rank among the pieces of its length;
ranks come from counts per (length, block of rows), summed in two levels, so no length, however common, is ever sorted
in one task.

Defined results: a null or empty text is one piece holding the end id; repeated rows are packed
separately; a null doc_id stays null; an empty table gives an empty table; extra columns are
ignored.
"""
from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import counts_before, texts
from seqlake.llm.lexicon_codec import Memory, cut_words, spelled
from seqlake.llm.ragged import byte_slices, offsets_of, spread
from seqlake.session import settle

SLICE_BYTES = 4 << 20      # of text encoded together
CACHE_BYTES = 48 << 20     # of words remembered by a worker, in either of two generations
ROWS_PER_RANK_BLOCK = 12   # as a power of two
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECE_COLUMNS = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id bigint, offset bigint"


class ChunkEncoder:
    """Token ids of whole texts. Of a slice of texts only the distinct words (cut at blanks, which no pre-token spans)
    are encoded, and words met before are remembered, bounded in bytes.

    Without ``ranks_file`` the tokenizer itself encodes. With one (the same vocabulary as ranks, and its
    pattern), the faster rank encoder does, and the tokenizer only texts with a special token's string;
    the ids are the same (tests compare them on every code point)."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None):
        self.tokenizer_file, self.tokenizer, self.ranks = tokenizer_file, None, None
        with open(tokenizer_file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks_file:
            import tiktoken
            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = Memory(CACHE_BYTES)

    def _encode(self, text: str) -> bytes:
        if self.ranks is not None and not any(s in text for s in self.special):
            return array("I", self.ranks.encode_ordinary(text)).tobytes()
        if self.tokenizer is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(self.tokenizer_file)
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        if self.ranks is None:
            return [self._encode(spelled(w)) for w in words]
        encode = self.ranks.encode_ordinary      # texts with a special token's string are not cut into words
        return [array("I", encode(spelled(w))).tobytes() for w in words]

    def encode(self, text: pa.Array) -> list[bytes]:
        """The ids of each text (none null) as little-endian uint32."""
        words, at, odd = cut_words(text, self.special)
        coded = words.dictionary_encode()
        which = np.asarray(coded.indices)
        raw = self.words.recall(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._words)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        n_word = size[which]
        ids = np.frombuffer(b"".join(raw), "<u4")[spread(offsets_of(size)[:-1][which], n_word)].tobytes()
        ends = (4 * offsets_of(n_word)[at]).tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for i in odd.tolist():      # with other white space, or a special token's string
            out[i] = self._encode(text[i].as_py())
        return out


@lru_cache(maxsize=1)
def encoder_of(*files: str | None) -> ChunkEncoder:
    """The worker's encoder, kept for its later tasks."""
    return ChunkEncoder(*files)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, a shorter one first if any."""
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None,
           capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of its little-endian uint32 ids)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_file, ranks_file, pattern)
        for part in byte_slices(batches, "text", SLICE_BYTES):
            rows = []
            for i, ids in enumerate(encoder.encode(part.column("text").combine_chunks())):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            row, piece, start, length, crc = zip(*rows)
            yield pa.record_batch({"doc_id": part.column("doc_id").combine_chunks().take(pa.array(row, pa.int64())),
                                   "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                                   "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return texts(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Runs of equal bins, (how many, lengths in a bin), that hold ``counts[length]`` items of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, tuple]]] = {}    # free room -> runs (how many, lengths as a linked list)

    def put(gap: int, many: int, lengths: tuple) -> None:
        gaps.setdefault(gap, []).append((many, lengths))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for partner in large:
            if not left[n]:
                break
            if partner > n or n + partner > capacity or not left[partner]:
                continue
            many = left[n] // 2 if partner == n else min(left[n], left[partner])
            if many:
                left[n] -= many
                left[partner] -= many
                put(capacity - n - partner, many, (partner, (n, None)))
        if left[n]:
            put(capacity - n, left[n], (n, None))
            left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo, gap = left[n], n
        while todo:
            while gap <= capacity and not gaps.get(gap):
                gap += 1
            if gap > capacity:
                per_bin = capacity // n
                whole, rest = divmod(todo, per_bin)
                for many, items in ((whole, per_bin), (1 if rest else 0, rest)):
                    if many:
                        lengths = None
                        for _ in range(items):
                            lengths = (n, lengths)
                        put(capacity - n * items, many, lengths)
                break
            many, lengths = gaps[gap].pop()
            used = min(many, todo)
            if used < many:
                gaps[gap].append((many - used, lengths))
            put(gap - n, used, (n, lengths))
            todo -= used
            if gap - n >= n:
                gap = gap - n    # what is left of these bins is now the tightest fit
    runs = []
    for many, lengths in (r for rs in gaps.values() for r in rs):
        flat = []
        while lengths:
            flat.append(lengths[0])
            lengths = lengths[1]
        runs.append((many, flat[::-1]))
    return runs


def places(runs: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan as slot ranges sorted by (length, first rank): ``many`` bins from ``bin`` on, at ``offset``."""
    rows, first, at = [], {}, 0
    for many, lengths in runs:
        offset = 0
        for n in lengths:
            rows.append((n, first.get(n, 0), at, offset))
            first[n] = first.get(n, 0) + many
            offset += n
        at += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


def pack(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    numbered = settle(cut_pieces.withColumn("rid", F.monotonically_increasing_id()))
    block = F.shiftright("rid", ROWS_PER_RANK_BLOCK)
    counts = settle(numbered.groupBy("length", block.alias("block")).agg(F.count("*").alias("n")))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()   # a row per length: at most `capacity`
    plan = spark.sparkContext.broadcast(places(plan_bins({r["length"]: r["n"] for r in by_length}, capacity)))
    offsets = counts_before(counts, "length", "block", "n", "before").drop("n")
    in_block = Window.partitionBy("length", "block").orderBy("rid")
    ranked = (numbered.withColumn("block", block).withColumn("rank", F.row_number().over(in_block) - 1)
              .join(offsets, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
              .select(*PIECE_COLUMNS, "rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        starts = p["length"] << 48 | p["rank"]
        for pdf in batches:
            rank = pdf.pop("rank").to_numpy(dtype=np.int64)
            at = np.searchsorted(starts, pdf["length"].to_numpy(dtype=np.int64) << 48 | rank, side="right") - 1
            pdf["sequence_id"] = p["bin"][at] + rank - p["rank"][at]
            pdf["offset"] = p["offset"][at]
            yield pdf

    return ranked.mapInPandas(place, PLACED_SCHEMA)

