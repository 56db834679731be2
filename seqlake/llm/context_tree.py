"""LM scoring: context-tree weighting over bytes.

A text is read as its words (A-Z lower-cased) with a blank between them and an end mark. A byte's
context is the ``depth`` bytes before it; the byte itself is decomposed into eight binary
decisions, each with its own node per context. A node's Krichevsky-Trofimov estimate is weighted
against the product of its children (the contexts one byte longer), from the full depth up to no
context at all; a decision's probability is mixed along the path of its contexts with these
weights, and the path ends where training has not seen the context. Probabilities sum to one over all texts, and the
negative logarithm is the code length.

The work runs on blocks of documents (about ``BLOCK_BYTES`` of text, packed into one row of a written table)
and shards of the model (by the last two context bytes, whose deeper contexts are all in the shard):

1. every block asks once for the distinct (context, byte) keys it holds, as sorted packed arrays, one row per shard,
   with its training counts;
2. a shard adds up the counts of all blocks, builds its trees, and keeps them as one row. Only the two levels above the
   shards (at most 65,536 nodes) pass through the driver and are broadcast;
3. the rows of a shard lie together, the model's first: each block's keys get their log probabilities. Keys that training
   has not seen are scored from the deepest context it has, and are in no table;
4. the rows of a block lie together, the answers first: its documents are scored with them.

Words for the unigram base go the same way, in shards of their 64-bit hashes. Nothing is joined a
row per document and key, nothing that grows with the corpus is broadcast, and a task holds one block or one shard.

Defined results: a null or empty text is the end mark alone; a null doc_id belongs to training;
repeated rows are separate documents; without training texts every decision has probability 1/2
and the base is that of an empty count; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import arrow_rows, texts
from seqlake.llm.ragged import byte_slices, offsets_of, text_buffer
from seqlake.session import release, settle

DEPTH = 6                  # context bytes; a key has one more, at most seven in all
BLOCK_BYTES = 24 << 20     # of text in a block
SLICE_BYTES = 1 << 20      # of text made into streams together
PIECE = 1 << 20            # bytes of a block whose keys are made at a time
SHARD_BYTES = 8 << 20      # of text for each shard of keys, and of words
MERGE_AT = 1 << 23         # keys of several blocks that a shard holds before it adds them up
END = 10                   # the end mark: a line break, which cannot be in a word
LOG_HALF = math.log(0.5)
GRAMS, WORDS = 0, 1
PART_BYTES = 2 << 20       # of a block's text whose words are looked at together, and that a row of the last step holds
ARROW_ROWS = 64

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# --- packed arrays -----------------------------------------------------------------------------

def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as compressed bytes, the differences if they ascend; equal places of all numbers lie together."""
    values = values.astype(np.int64)
    if ascending:
        values = np.diff(values, prepend=np.int64(0))
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1)
    return np.cumsum(values) if ascending else values


def packed_floats(values: np.ndarray) -> bytes:
    """Floats in single precision as compressed bytes, equal places together."""
    return zstandard.compress(values.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_floats(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<f4").reshape(-1)


# --- texts as byte decisions -------------------------------------------------------------------

def stream(data: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts as their lower-cased words with one blank between them and the end mark after them."""
    n, blank = len(data), _BLANK[data]
    solid = np.flatnonzero(~blank)
    keep = ~blank
    doc = np.searchsorted(doc_at, solid, side="right")
    gap = np.flatnonzero((np.diff(solid) > 1) & (doc[1:] == doc[:-1])) + 1      # a word after white space in the same text
    keep[solid[gap] - 1] = True
    at = offsets_of(keep)[doc_at]
    plain = np.where(blank, np.uint8(0x20), _LOWER[data])[keep]
    docs = len(doc_at) - 1
    out = np.full(len(plain) + docs, END, dtype=np.uint8)
    lengths = np.diff(at)
    out[np.arange(len(plain)) + np.repeat(np.arange(docs), lengths)] = plain
    return out, offsets_of(lengths + 1)


def grams(data: np.ndarray, doc_at: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
    """For every byte from ``lo`` to ``hi`` of the streams the number whose bytes are its context, nearest first, and itself."""
    before = min(lo, depth)
    raw = np.full(depth + hi - lo + 8, END, dtype=np.uint8)
    raw[depth - before:depth + hi - lo] = data[lo - before:hi]
    # eight bytes from depth before a byte on, read as a number: the nearest is the highest of the first depth ones
    context = np.ndarray(hi - lo, dtype="<u8", buffer=raw, strides=(1,)).astype(np.int64) & ((1 << 8 * depth) - 1)
    keys = context << 8 | data[lo:hi]
    # near the beginning of a stream the context goes on with end marks
    first = doc_at[np.searchsorted(doc_at, lo - depth, side="right"):np.searchsorted(doc_at, hi, side="left")]
    for i in range(depth):
        place = first + i
        place = place[(place >= lo) & (place < hi)]
        begin = doc_at[np.searchsorted(doc_at, place, side="right") - 1]
        keys[place - lo] = data[place]
        for d in range(1, depth + 1):
            earlier = np.where(place - d >= begin, data[np.maximum(place - d, 0)], np.uint8(END)).astype(np.int64)
            keys[place - lo] |= earlier << (8 * (depth + 1 - d))
    return keys


def added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    key, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def gram_counts(data: np.ndarray, doc_at: np.ndarray, learnt: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the streams with their counts in the first ``learnt`` bytes (the training texts)."""
    keys, counts = [], []
    for a, b, weight in ((0, learnt, 1), (learnt, len(data), 0)):
        for lo in range(a, b, PIECE):
            found, n = np.unique(grams(data, doc_at, lo, min(lo + PIECE, b), depth), return_counts=True)
            keys.append(found)
            counts.append(n * weight)
            if sum(map(len, keys[1:])) > max(PIECE, len(keys[0])):
                keys, counts = ([x] for x in added_up(keys, counts))
    return added_up(keys, counts)


def block_words(data: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, number of the distinct word of every word, words of each stream)."""
    solid = (data != 0x20) & (data != END)
    first = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    last = np.flatnonzero(solid & ~np.r_[solid[1:], False])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [
        None, pa.py_buffer(offsets_of(last + 1 - first)), pa.py_buffer(data[solid])]).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words.dictionary.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words.dictionary))
    return hashes.view(np.int64), np.asarray(words.indices), np.diff(np.searchsorted(first, doc_at))


class Block:
    """Documents as streams, training texts first; goes around as one compressed value."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, at: np.ndarray, data: np.ndarray, training: int):
        self.ids, self.null, self.at, self.data, self.training = ids, null, at, data, training
        self.learnt = int(at[training])

    @staticmethod
    def of(doc_id: pa.Array, held_out: np.ndarray, text: pa.Array) -> "Block":
        order = pa.array(np.argsort(held_out, kind="stable"))
        text, doc_id = text.take(order), doc_id.take(order)
        streams, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for part in byte_slices([pa.record_batch({"text": text})], "text", SLICE_BYTES):      # some numbers are kept for every byte
            data, at = stream(*text_buffer(part.column("text").combine_chunks()))
            streams.append(data)
            sizes.append(np.diff(at))
        return Block(np.asarray(doc_id.fill_null(0)).astype(np.int64), np.asarray(doc_id.is_null()).astype(np.int64),
                     offsets_of(np.concatenate(sizes)), np.concatenate(streams), int((~held_out).sum()))

    def pack(self) -> bytes:
        head = np.array([len(self.ids), self.training], dtype=np.int64)
        return zstandard.compress(b"".join(x.tobytes() for x in (head, self.ids, self.null, self.at, self.data)), 3)

    @staticmethod
    def unpack(payload: bytes) -> "Block":
        raw = zstandard.decompress(payload)
        docs, training = np.frombuffer(raw, np.int64, 2).tolist()
        ids, null, at = (np.frombuffer(raw, np.int64, n, o) for n, o in ((docs, 16), (docs, 16 + 8 * docs), (docs + 1, 16 + 16 * docs)))
        return Block(ids, null, at, np.frombuffer(raw, np.uint8, offset=24 + 24 * docs), training)

    def parts(self, size: int) -> Iterator["Block"]:
        """The same documents in blocks of about ``size`` bytes."""
        lo = 0
        while lo < len(self.ids):
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + size, side="right")) - 1)
            yield Block(self.ids[lo:hi], self.null[lo:hi], self.at[lo:hi + 1] - self.at[lo], self.data[self.at[lo]:self.at[hi]],
                        min(max(self.training - lo, 0), hi - lo))
            lo = hi


def word_counts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a block, ascending, with their counts in its training texts."""
    hashes, counts = [], []
    for part in block.parts(PART_BYTES):
        found, which, words = block_words(part.data, part.at)
        hashes.append(found)
        counts.append(np.bincount(which[:int(words[:part.training].sum())], minlength=len(found)))
    return added_up(hashes, counts)


# --- the tree of a shard -----------------------------------------------------------------------

_TABLED = 1 << 12
_LOG_HALVES, _LOG_ONES = (np.r_[0.0, np.cumsum(np.log(np.arange(_TABLED) + first))] for first in (0.5, 1.0))


def _log_rising(n: np.ndarray, first: float, table: np.ndarray) -> np.ndarray:
    """log(first (first + 1) ... (first + n - 1)), by Stirling's formula beyond the table."""
    out = table[np.minimum(n, _TABLED)]
    big = np.flatnonzero(n > _TABLED)
    if len(big):
        x = n[big].astype(float) + first
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) - math.lgamma(first)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts under the Krichevsky-Trofimov estimator."""
    return _log_rising(zeros, 0.5, _LOG_HALVES) + _log_rising(ones, 0.5, _LOG_HALVES) - _log_rising(zeros + ones, 1.0, _LOG_ONES)


class Nodes:
    """The nodes of one context depth and one of the eight decisions, ascending by (context, decision number): counts, and
    the logarithm of the weighted probability, given the sums of it over their children (None at full depth)."""

    def __init__(self, number: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
        self.number, self.zeros, self.ones = number, zeros, ones
        estimate = log_kt(zeros, ones)
        self.log_weighted = estimate if children is None else LOG_HALF + np.logaddexp(estimate, children)
        self.stop = np.ones(len(number)) if children is None else np.exp(LOG_HALF + estimate - self.log_weighted)

    def above(self) -> np.ndarray:
        """The numbers of the nodes with a context one byte shorter."""
        return (self.number >> 16) << 8 | self.number & 255

    def mix(self, parents: "Nodes | None") -> None:
        """From the shortest context down: the probability that a path ending here gives to a zero and a one (``end``), what
        shorter contexts have given (``given``), and the weight that is left (``left``)."""
        at = np.searchsorted(parents.number, self.above()) if parents is not None else np.zeros(len(self.number), np.int64)
        own = np.stack([self.zeros + 0.5, self.ones + 0.5]) / (self.zeros + self.ones + 1)
        if parents is None:
            self.given, self.left = np.zeros((2, len(at))), np.ones(len(at))
        else:
            self.given, self.left = parents.passed[:, at], (parents.left * (1 - parents.stop))[at]
        self.end = self.given + self.left * own
        self.passed = self.given + self.left * self.stop * own


def decisions(byte: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(decision number 1..255, bit) of the k-th bit of bytes."""
    return 1 << k | byte >> (8 - k), byte >> (7 - k) & 1


def build(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[list[Nodes]]:
    """Levels ``top`` to ``depth`` of the tree of ascending keys, each with its eight lists of nodes."""
    levels: list[list[Nodes]] = []
    rows, n = keys[counts > 0], counts[counts > 0]
    for d in range(depth, top - 1, -1):
        context, byte, level = rows >> 8, rows & 255, []
        for k in range(8):
            number, bit = decisions(byte, k)
            node = context << 8 | number                     # ascending, as the rows are
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
            total, ones = (np.add.reduceat(x, first) if len(first) else x[:0] for x in (n, n * bit))
            node, children = node[first], None
            if levels:
                below = levels[0][k]
                children = np.bincount(np.searchsorted(node, below.above()), weights=below.log_weighted, minlength=len(node))
            level.append(Nodes(node, total - ones, ones, children))
        levels.insert(0, level)
        rows, n = added_up([(context >> 8) << 8 | byte], [n])
    return levels


def mixed(levels: list[list[Nodes]]) -> list[list[Nodes]]:
    """``levels`` from depth 0 on, with the probabilities of the paths that end at each node."""
    for d, level in enumerate(levels):
        for k in range(8):
            level[k].mix(levels[d - 1][k] if d else None)
    return levels


def log10_probability(keys: np.ndarray, levels: list[list[Nodes]]) -> np.ndarray:
    """log10 of the probability of each key's byte in its context; the path ends at the deepest context seen."""
    out, depth = np.zeros(len(keys)), len(levels) - 1
    for k in range(8):
        number, bit = decisions(keys & 255, k)
        p, todo = np.full(len(keys), 0.5), np.arange(len(keys))
        for d in range(depth, -1, -1):
            nodes = levels[d][k]
            if not len(nodes.number) or not len(todo):
                continue
            node = (keys[todo] >> 8 * (depth - d + 1)) << 8 | number[todo]
            at = np.minimum(np.searchsorted(nodes.number, node), len(nodes.number) - 1)
            seen = nodes.number[at] == node
            p[todo[seen]] = nodes.end[bit[todo[seen]], at[seen]]
            todo = todo[~seen]
        out += np.log10(p)
    return out


# --- Spark jobs --------------------------------------------------------------------------------

PACKED_SCHEMA = "block bigint, payload binary"
ASKED_SCHEMA = "kind int, shard bigint, block bigint, keys binary, counts binary, n bigint, tokens bigint, ends bigint"
MODEL_SCHEMA = "shard bigint, keys binary, counts binary, upper binary, below binary"
ROW_SCHEMA = "block bigint, place int, kind int, keys binary, answers binary"
SCORED_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def packed_blocks(docs: DataFrame) -> DataFrame:
    """(block, payload); ``docs`` has doc_id, text, held_out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId() << 32
        for i, part in enumerate(byte_slices(batches, "text", BLOCK_BYTES)):
            part = part.combine_chunks()
            block = Block.of(part.column("doc_id").combine_chunks(), np.asarray(part.column("held_out").combine_chunks().cast(pa.uint8())) > 0,
                             part.column("text").combine_chunks())
            yield pa.record_batch({"block": pa.array([task + i]), "payload": pa.array([block.pack()], pa.binary())})

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, PACKED_SCHEMA)


def asked(blocks: DataFrame, depth: int, shards: int) -> DataFrame:
    """What every block asks of every shard: its distinct keys with their training counts; words likewise. ``tokens`` and
    ``ends`` (training words, training texts) stand in one row of a block."""
    spread_ = np.random.default_rng(0).permutation(1 << 16) % shards       # shard of the last two context bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                block, rows = Block.unpack(payload.as_py()), []
                words, times = word_counts(block)
                keys, n = gram_counts(block.data, block.at, block.learnt, depth)
                for kind, key, count, shard in (
                        (GRAMS, keys, n, spread_[keys >> 8 * (depth - 1)]),
                        (WORDS, words, times, (words.view(np.uint64) >> np.uint64(32)).astype(np.int64) * shards >> 32)):
                    by = np.argsort(shard, kind="stable")
                    edge = np.searchsorted(shard[by], np.arange(shards + 1))
                    for s in np.flatnonzero(np.diff(edge)).tolist():
                        part = by[edge[s]:edge[s + 1]]
                        rows.append((kind, s, number, packed(key[part], True), packed(count[part]), len(part), 0, 0))
                rows.append((-1, -1, number, b"", b"", 0, int(times.sum()), block.training))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([
                    ("kind", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
                    ("n", pa.int64()), ("tokens", pa.int64()), ("ends", pa.int64())]))

    return blocks.mapInArrow(run, ASKED_SCHEMA)


def model_shards(asks: DataFrame, depth: int) -> DataFrame:
    """One row per shard: its training keys with their counts, and what the two levels above need of its trees: per
    (nearest context byte, decision) zeros, ones and the logarithm of the weighted probability below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, held = None, [], [], 0

        def row():
            key, n = added_up(keys, counts)
            key, n = key[n > 0], n[n > 0]
            top = build(key, n, depth, 2)[0]
            node, place = np.unique(np.concatenate([x.above() for x in top]), return_inverse=True)
            sums = [np.bincount(place, weights=np.concatenate([getattr(x, c) for x in top]), minlength=len(node))
                    for c in ("zeros", "ones", "log_weighted")]
            upper = np.concatenate([node, *(x.astype(np.int64) for x in sums[:2])])
            yield pa.record_batch({"shard": pa.array([now]), "keys": pa.array([packed(key, True)], pa.binary()),
                                   "counts": pa.array([packed(n)], pa.binary()), "upper": pa.array([packed(upper)], pa.binary()),
                                   "below": pa.array([sums[2].astype(float).tobytes()], pa.binary())})

        for batch in batches:
            for shard, key, n in zip(batch.column("shard").to_pylist(), batch.column("keys"), batch.column("counts")):
                if shard != now:
                    if now is not None:
                        yield from row()
                    now, keys, counts, held = shard, [], [], 0
                keys.append(unpacked(key.as_py(), True))
                counts.append(unpacked(n.as_py()))
                held += len(keys[-1])
                if held > MERGE_AT and len(keys) > 1:
                    key, n = added_up(keys, counts)
                    keys, counts, held = [key], [n], len(key) // 2
        if now is not None:
            yield from row()

    return (asks.where(F.col("kind") == GRAMS).select("shard", "keys", "counts").repartition("shard")
            .sortWithinPartitions("shard").mapInArrow(run, MODEL_SCHEMA))


def upper_levels(model: DataFrame) -> list[list[Nodes]]:
    """The levels of no context byte and of one; at most 256 x 255 rows come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for upper, below in zip(batch.column("upper"), batch.column("below")):
                node, zeros, ones = unpacked(upper.as_py()).reshape(3, -1)
                yield pa.record_batch({"node": node, "zeros": zeros, "ones": ones, "below": np.frombuffer(below.as_py())})

    upper = (model.select("upper", "below").mapInArrow(run, "node bigint, zeros bigint, ones bigint, below double")
             .groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).orderBy("node").toPandas())
    node, zeros, ones = (upper[c].to_numpy(dtype=np.int64) for c in ("node", "zeros", "ones"))
    below, levels = upper["below"].to_numpy(dtype=float), [[], []]
    for k in range(8):
        mine = (node & 255) >> k == 1
        one = Nodes(node[mine], zeros[mine], ones[mine], below[mine])
        number, place = np.unique(one.above(), return_inverse=True)
        sums = [np.bincount(place, weights=x, minlength=len(number)) for x in (one.zeros, one.ones, one.log_weighted)]
        levels[0].append(Nodes(number, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2]))
        levels[1].append(one)
    return levels


def gram_answers(asks: DataFrame, model: DataFrame, upper, depth: int) -> DataFrame:
    """(block, place, kind, keys, answers): the log10 probability of every key that a block asks for, as float32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logp, levels = None, None, None
        for batch in batches:
            for block, key, n in zip(batch.column("block").to_pylist(), batch.column("keys"), batch.column("counts")):
                keys = unpacked(key.as_py(), True)
                if block is None:                # the shard's model
                    levels = mixed([*upper.value, *build(keys, unpacked(n.as_py()), depth, 2)])
                    known, logp = keys, log10_probability(keys, levels).astype(np.float32)
                    continue
                out = np.zeros(len(keys), dtype=np.float32)
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                seen = known[at] == keys if len(known) else np.zeros(len(keys), dtype=bool)
                out[seen] = logp[at[seen]]
                out[~seen] = log10_probability(keys[~seen], levels)
                yield _answer(block, GRAMS, key.as_py(), packed_floats(out))

    rows = asks.where(F.col("kind") == GRAMS).select("shard", "block", "keys", "counts").unionByName(
        model.select("shard", F.lit(None).cast("bigint").alias("block"), "keys", "counts"))
    return rows.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, ROW_SCHEMA)


def word_answers(asks: DataFrame) -> tuple[DataFrame, int]:
    """The training count of every word that a block asks for, as rows like those of the keys; and how many words training
    has. Words are dealt evenly by their hashes, so a shard's rows are held until they are added up and answered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def answered():
            keys = [unpacked(k, True) for _, k, _ in rows]
            known, total = added_up(keys, [unpacked(n) for _, _, n in rows])
            for (block, raw, _), key in zip(rows, keys):
                yield _answer(block, WORDS, raw, packed(total[np.searchsorted(known, key)]))
            yield _answer(-1, WORDS, b"", packed(np.array([int((total > 0).sum())])))

        for batch in batches:
            for shard, block, key, n in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("keys"), batch.column("counts")):
                if shard != now:
                    if rows:
                        yield from answered()
                    now, rows = shard, []
                rows.append((block, key.as_py(), n.as_py()))
        if rows:
            yield from answered()

    words = asks.where(F.col("kind") == WORDS).select("shard", "block", "keys", "counts")
    answers = settle(words.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, ROW_SCHEMA))
    distinct = sum(int(unpacked(bytes(r["answers"]))[0]) for r in answers.where("block < 0").select("answers").toLocalIterator())   # a row per shard
    return answers.where("block >= 0"), distinct


def _answer(block: int, kind: int, keys: bytes, answers: bytes) -> pa.RecordBatch:
    return pa.record_batch({"block": pa.array([block]), "place": pa.array([0], pa.int32()), "kind": pa.array([kind], pa.int32()),
                            "keys": pa.array([keys], pa.binary()), "answers": pa.array([answers], pa.binary())})


class Slots:
    """A hash table in numpy: open addressing with linear probing over at least twice as many slots as keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]    # of several keys for a slot the last one written stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are in the table."""
        at = self._home(keys)
        out = self.values[at].astype(float)
        wrong = np.flatnonzero(self.keys[at] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[wrong]
            out[wrong[hit]] = self.values[at[hit]]
            wrong, at = wrong[~hit], at[~hit]
        return out


def answer_tables(answers: list[tuple[int, bytes, bytes]]) -> tuple[Slots, np.ndarray, np.ndarray]:
    """(log probabilities by key, ascending word hashes, their training counts) of a block's answers (kind, keys, answers)."""
    grams_, words = ([a for a in answers if a[0] == kind] for kind in (GRAMS, WORDS))
    slots = Slots(np.concatenate([np.zeros(0, np.int64), *(unpacked(k, True) for _, k, _ in grams_)]),
                  np.concatenate([np.zeros(0, np.float32), *(unpacked_floats(a) for _, _, a in grams_)]))
    known = np.concatenate([np.zeros(0, np.int64), *(unpacked(k, True) for _, k, _ in words)])
    order = np.argsort(known)
    return slots, known[order], np.concatenate([np.zeros(0, np.int64), *(unpacked(a) for _, _, a in words)])[order]


def scored_block(block: Block, tables: tuple[Slots, np.ndarray, np.ndarray], depth: int, tokens: int, kinds: int, ends: int) -> pa.RecordBatch:
    """The documents of a block, or of a part of it, with their scores."""
    slots, known, counts = tables
    docs, score = len(block.at) - 1, np.zeros(len(block.at) - 1)
    for lo in range(0, len(block.data), PIECE):
        hi = min(lo + PIECE, len(block.data))
        sums = offsets_of_floats(slots.look_up(grams(block.data, block.at, lo, hi, depth)))
        score += np.diff(sums[np.clip(block.at, lo, hi) - lo])
    hashes, which, words = block_words(block.data, block.at)
    c = counts[np.searchsorted(known, hashes)] if len(hashes) else counts[:0]
    denominator = tokens + 0.5 * (kinds + 1)
    doc = np.repeat(np.arange(docs), words)
    base = np.bincount(doc, weights=np.log10((c + 0.5) / denominator)[which], minlength=docs) + math.log10((ends + 0.5) / denominator)
    n_known = np.bincount(doc, weights=(c > 0)[which], minlength=docs).astype(np.int64) + (ends > 0)
    return pa.record_batch({"doc_id": pa.array(block.ids, pa.int64(), mask=block.null > 0), "held_out": pa.array(np.arange(docs) >= block.training), "n_tokens": words + 1,
                            "n_known": n_known, "base_score": base, "score": score})


def offsets_of_floats(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1)
    np.cumsum(values, out=out[1:])
    return out


def payload_parts(blocks: DataFrame) -> DataFrame:
    """(block, place, kind, keys, answers): the blocks' documents in rows of about ``PART_BYTES`` of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                for part in Block.unpack(payload.as_py()).parts(PART_BYTES):
                    yield pa.record_batch({"block": pa.array([number]), "place": pa.array([1], pa.int32()), "kind": pa.array([0], pa.int32()),
                                           "keys": pa.array([b""], pa.binary()), "answers": pa.array([part.pack()], pa.binary())})

    return blocks.mapInArrow(run, ROW_SCHEMA)


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document row."""
    spark = docs.sparkSession
    marked = texts(docs, id_col, text_col).withColumn(
        "held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1)
    blocks = settle(packed_blocks(marked))
    size = marked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    with arrow_rows(spark, ARROW_ROWS):       # rows of packed arrays are long
        asks = settle(asked(blocks, depth, int(min(1 << 16, 1 + size // SHARD_BYTES))))
        tokens, ends = asks.where("kind = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
        model = settle(model_shards(asks, depth))
        upper = spark.sparkContext.broadcast(upper_levels(model))
        words, kinds = word_answers(asks)
        tokens, kinds = tokens + ends, kinds + (ends > 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, answers, tables = None, [], None
            for batch in batches:
                for block, place, kind, keys, value in zip(batch.column("block").to_pylist(), batch.column("place").to_pylist(),
                                                           batch.column("kind").to_pylist(), batch.column("keys"), batch.column("answers")):
                    if block != now:
                        now, answers, tables = block, [], None
                    if place == 0:
                        answers.append((kind, keys.as_py(), value.as_py()))
                    else:
                        tables, answers = tables or answer_tables(answers), []
                        yield scored_block(Block.unpack(value.as_py()), tables, depth, tokens, kinds, ends)

        rows = gram_answers(asks, model, upper, depth).unionByName(words).unionByName(payload_parts(blocks))
        scored = settle(rows.repartition("block").sortWithinPartitions("block", "place").mapInArrow(run, SCORED_SCHEMA))
        release(blocks, asks, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
