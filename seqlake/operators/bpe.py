"""Byte-pair encoding as corpus jobs.

Training (B3) is in :mod:`seqlake.operators.bpe_training`. Encoding (B4) is a map over the rows: the
distinct N-free segments of a batch that the worker does not remember are merged over a linked
array with a heap of pairs (lowest rank first, then leftmost), in time linear-logarithmic in
the segment's length whatever the number of merges; nothing is shuffled.
"""
from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.dna import upper_dna
from seqlake.operators.bpe_training import MAX_PIECES, TASK_LETTERS, learn_merges

# Special tokens (ids 0, 1, 2) and the alphabet every vocabulary starts with.
PAD, BOS, EOS = "[PAD]", "[BOS]", "[EOS]"
SPECIALS = [PAD, BOS, EOS]
PAD_ID, BOS_ID, EOS_ID = 0, 1, 2
INITIAL_ALPHABET = ["A", "T", "C", "G", "N"]
UNK = "N"

MAX_TOKENS = 0xD800      # ids travel as characters between the driver and tasks: those before the surrogates
SEPARATOR = "\x00"        # between the tokens of a decoding table
CACHE_BYTES = 16 << 20    # of segments a worker remembers, in either of two generations
CACHED_LENGTH = 256       # longer segments are not remembered
ENTRY_BYTES = 200         # a remembered segment besides its letters and ids
BATCH_LETTERS = 1 << 19       # of texts that a worker encodes at a time
COUNTED_LETTERS = 1 << 24     # whose segments a task counts before it sends them
COUNTED_SEGMENTS = 1 << 18    # distinct ones, likewise


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------------------------
# B1 / B2: segment and pair counts

def segment_counts(df: DataFrame, seq_col: str = "sequence") -> DataFrame:
    """B1: distinct N-free segments of the upper-cased sequences with their multiplicity; a task counts before it sends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                found.update(text.split(UNK))
                size += len(text)
                if size > COUNTED_LETTERS or len(found) > COUNTED_SEGMENTS:
                    yield counted(found)
                    found, size = Counter(), 0
        yield counted(found)

    def counted(found: Counter) -> pa.RecordBatch:
        found.pop("", None)
        return pa.record_batch({"segment": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return (df.select(upper_dna(seq_col).alias("text")).mapInArrow(run, "segment string, n bigint")
            .groupBy("segment").agg(F.sum("n").alias("n")))


def adjacent_pairs(s: Column) -> Column:
    """Array of the overlapping 2-character windows of ``s`` (empty below length 2)."""
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1),
                                                lambda i: F.substring(s, i, 2))).otherwise(F.array())


def pair_counts(segs: DataFrame, col: str = "segment", weight: str = "n") -> DataFrame:
    """B2: weighted adjacent-pair counts (``AAAA`` counts ``AA`` three times)."""
    return (segs.select(F.explode(adjacent_pairs(F.col(col))).alias("pair"), F.col(weight))
            .groupBy("pair").agg(F.sum(weight).cast("bigint").alias("n")))


# ---------------------------------------------------------------------------------------------
# training

@dataclass
class BpeModel:
    """A trained vocabulary: ``vocab`` (token_id, token, kind) and ``merges`` (rank, left_id,
    right_id, new_id, token, n) as small driver-side lists (bounded by the vocabulary size)."""
    tokens: list[str]
    merges: list[tuple[int, int, int, int, str, int]]

    @property
    def alphabet(self) -> list[str]:
        return [t for t in self.tokens[len(SPECIALS):] if len(t) == 1]

    def vocab_df(self, spark) -> DataFrame:
        rows = [(i, t, "special" if i < len(SPECIALS) else ("char" if len(t) == 1 and i < len(SPECIALS) + len(self.alphabet) else "merge"))
                for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "token_id INT, token STRING, kind STRING")

    def merges_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.merges, "rank INT, left_id INT, right_id INT, new_id INT, token STRING, n BIGINT")

    @staticmethod
    def from_frames(vocab: DataFrame, merges: DataFrame) -> "BpeModel":
        toks = [r.token for r in vocab.orderBy("token_id").collect()]
        ms = [tuple(r) for r in merges.select("rank", "left_id", "right_id", "new_id", "token", "n")
              .orderBy("rank").collect()]
        return BpeModel(toks, ms)


def train_bpe(segs: DataFrame, vocab_size: int = 8192, min_frequency: int = 0, max_token_length: int | None = None,
              col: str = "segment", weight: str = "n", max_pieces: int = MAX_PIECES, report=None) -> BpeModel:
    """Learn merges from a distinct-segment table (B1 output).

    Vocabulary = the three specials, then the sorted alphabet (every character of the corpus plus
    A, T, C, G, N), then one token per merge until ``vocab_size`` is reached or no pair is left. The next
    merge is the pair of highest weighted count, ties to the smallest (left id, right id).
    A merge whose token already exists reuses its id; a merge longer than ``max_token_length`` is
    skipped; training stops when the best count is below ``min_frequency`` (or 1).
    """
    if vocab_size > MAX_TOKENS:
        raise ValueError(f"vocab_size above {MAX_TOKENS} is not supported")
    segs = segs.select(F.col(col).alias(col), F.col(weight).alias(weight)).persist(StorageLevel.MEMORY_AND_DISK)
    letters = segs.agg(F.sum(F.length(col))).first()[0] or 0
    chars = (segs.select(F.explode(F.regexp_extract_all(F.col(col), F.lit("(?s)."), 0)).alias("c"))
             .distinct().collect())
    tokens = SPECIALS + sorted(set(r.c for r in chars) | set(INITIAL_ALPHABET), key=ord)
    few = segs.coalesce(max(segs.sparkSession.sparkContext.defaultParallelism, -(-letters // TASK_LETTERS)))
    merges = learn_merges(few, tokens, vocab_size, min_frequency, max_token_length, col, weight, max_pieces, report)
    segs.unpersist()
    return BpeModel(tokens, merges)


# ---------------------------------------------------------------------------------------------
# Encode and decode

class SegmentEncoder:
    """Ids of segments by merging the pair of lowest rank, leftmost first, until no pair merges."""

    def __init__(self, ids: dict[str, int], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ids, self.ranks = ids, ranks
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merge(self, segment: str) -> list[int]:
        """Ids over a linked array: ``after`` and ``before`` link what is left, a heap has the pairs that may merge."""
        sym = [self.ids[c] for c in segment]
        end, ranks = len(sym), self.ranks
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r[0], i) for i in range(end - 1) if (r := ranks.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= end:
                continue
            found = ranks.get((sym[i], sym[j]))
            if found is None or found[0] != rank:       # a symbol of the pair has merged meanwhile
                continue
            sym[i], sym[j] = found[1], -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if r := ranks.get((sym[i], sym[k])):
                    heapq.heappush(heap, (r[0], i))
            if (h := before[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))):
                heapq.heappush(heap, (r[0], h))
        return [s for s in sym if s >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of masked texts as int32 bytes; every N is a piece of its own."""
        if self.held > CACHE_BYTES:
            self.known, self.older, self.held = {"": b""}, self.known, 0
        n, known, long_ = np.int32(self.ids[UNK]).tobytes(), self.known, []
        cut = [t.split(UNK) for t in texts]
        for s in {s for c in cut for s in c if s not in known}:
            ids = known[s] = self.older.get(s) or np.array(self.merge(s), np.int32).tobytes()
            if len(s) > CACHED_LENGTH:
                long_.append(s)
            else:
                self.held += len(s) + len(ids) + ENTRY_BYTES
        out = [n.join(map(known.__getitem__, c)) for c in cut]
        for s in long_:
            del known[s]
        return out


class TokenText:
    """Normalised sequences (D1) with the characters that have no token masked, before any merge: as ``mask_unknown`` of
    ``normalise_dna``, in the task that encodes them."""

    def __init__(self, alphabet: list[str]):
        upper = {c: c.upper() for c in "acgtn"}
        self.ascii = {i: c if (c := upper.get(chr(i), chr(i))) in alphabet else UNK for i in range(128)}
        self.upper = str.maketrans(upper)
        self.unknown = re.compile(f"[^{re.escape(''.join(alphabet))}]")

    def __call__(self, text: str | None) -> str:
        if text is None:
            return ""
        if text.isascii():
            return text.translate(self.ascii)
        return self.unknown.sub(UNK, unicodedata.normalize("NFKC", text).translate(self.upper))


def letters_at_a_time(batch: pa.RecordBatch, text: pa.StringArray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turns of about BATCH_LETTERS of their texts, so that a task's memory is not that of the batch."""
    turn = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // BATCH_LETTERS
    at = np.r_[0, np.flatnonzero(turn[1:] != turn[:-1]) + 1, len(turn)]
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield batch.slice(lo, hi - lo)


def encode_bpe(df: DataFrame, model: BpeModel, seq_col: str = "sequence", out: str = "input_ids", keep: list[str] | None = None) -> DataFrame:
    """D1 normalisation, unknown characters to N, merges, ids (no specials). A null sequence has no ids. ``keep``: the columns
    that go with the ids (all, if not given)."""
    ids = {t: i for i, t in enumerate(model.tokens) if i >= len(SPECIALS) and len(t) == 1}
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, left, right, new, _, _ in model.merges:
        ranks[(left, right)] = (rank, new)
    shared = df.sparkSession.sparkContext.broadcast((ids, ranks))
    kept = [f for f in df.schema.fields if f.name != out and (keep is None or f.name in keep)]
    alphabet = model.alphabet
    schema = T.StructType(kept + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, masked = SegmentEncoder(*shared.value), TokenText(alphabet)
        for batch in (part for whole in batches for part in letters_at_a_time(whole, whole.column(text_at))):
            raw = encoder.encode([masked(t) for t in batch.column(text_at).to_pylist()])
            at = np.zeros(len(raw) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in raw], out=at[1:])
            column = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays(batch.columns[:len(kept)] + [column], names=[f.name for f in schema.fields])

    names = [f.name for f in kept]
    text_at = names.index(seq_col) if seq_col in names else len(kept)      # a text that goes with the ids is sent once
    text = [] if seq_col in names else [F.col(seq_col).alias("__token_text")]
    return df.select(*(F.col(f"`{n}`") for n in names), *text).mapInArrow(run, schema)


def decode_bpe(ids, model: BpeModel) -> Column:
    """Token strings fused without separator (specials included as written)."""
    if any(SEPARATOR in t for t in model.tokens):
        raise ValueError("a token holds the separator of the decoding table")
    table = F.split(F.lit(SEPARATOR.join(model.tokens)), SEPARATOR)      # folded to one constant
    return F.array_join(F.transform(_col(ids), lambda i: F.element_at(table, i + 1)), "")


# ---------------------------------------------------------------------------------------------
# Specials, truncation, base tokens

def wrap_special(ids, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    """``[BOS] ids [EOS]``."""
    return F.concat(F.array(F.lit(bos)), _col(ids), F.array(F.lit(eos)))


def wrap_pair(a, b, bos: int = BOS_ID, eos: int = EOS_ID) -> tuple[Column, Column]:
    """B5 pair form: ``[BOS] A [EOS] [BOS] B [EOS]`` and its type ids (0 for A, 1 for B)."""
    wa, wb = wrap_special(a, bos, eos), wrap_special(b, bos, eos)
    types = F.concat(F.array_repeat(F.lit(0), F.size(wa)), F.array_repeat(F.lit(1), F.size(wb)))
    return F.concat(wa, wb), types


def truncate(ids, max_length: int, specials: bool = True) -> Column:
    """Truncation counting the two specials, then wrapping."""
    if specials:
        return wrap_special(F.slice(_col(ids), 1, max_length - 2))
    return F.slice(_col(ids), 1, max_length)


def encode_bases(c, max_length: int | None = None) -> Column:
    """One token per byte of the sequence (its UTF-8 value), no specials. ASCII text (every
    normalised DNA sequence) takes the direct code-point path; other text goes through its bytes."""
    c = _col(c)
    via_bytes = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), 0),
                            lambda h: F.conv(h, 16, 10).cast("int"))
    direct = F.transform(F.split(c, ""), lambda ch: F.ascii(ch))
    ids = F.when(c == "", F.array().cast("array<int>")).when(c.rlike("[^\\x00-\\x7F]"), via_bytes).otherwise(direct)
    return F.slice(ids, 1, max_length) if max_length else ids


def token_stats(df: DataFrame, by: list[str], ids: str = "input_ids", seq_col: str = "sequence") -> DataFrame:
    """Tokens per sequence and bases per token per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.sum(F.size(ids)).cast("bigint").alias("n_tokens"),
        F.sum(F.length(seq_col)).cast("bigint").alias("n_bases"),
    ).withColumn("bases_per_token", F.round(F.col("n_bases") / F.col("n_tokens"), 6))


def vocab_usage(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """How often each token id occurs."""
    return df.select(F.explode(ids).alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
