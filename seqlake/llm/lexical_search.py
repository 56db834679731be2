"""Ranked lexical search: dense blocked BLAS multiplication.

Items (the queries) and documents are cut into terms. Documents are read once into compact
vectors: the numbers of the items' terms they hold, how often, and their length. For a block of documents,
the terms of the block are dealt into tiles; a tile of the item matrix (weights w) times the
tile of document impacts is one float64 matrix product. All entries are whole numbers, and a tile has so few
terms that no partial sum reaches 2**53, so every product is exact; tiles are added as int64.
Of each block's scores those that can still be among the first ``top`` of an item are merged into the task's list
by (score descending, doc_id ascending), ties included; the lists of tasks meet in two steps.

Defined results: a null or empty text has no terms, gives no rows and counts neither as a document
nor for lengths; repeated document rows rank each; a null doc_id ranks after all others of its
score; items with one id are one item with the terms of all; an item or corpus without terms
gives no rows; other columns are ignored.

Bounds: items are taken in groups of at most ``group_terms`` terms (or one item), each broadcast
and searched by itself, so a longer list of items takes more passes, not more memory.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import texts
from seqlake.llm.ragged import offsets_of, spread
from seqlake.session import settle

GROUP_TERMS = 1 << 17      # terms of the items that one pass searches for, repeats included
BLOCK_DOCS = 1024          # documents whose scores are computed together
TILE_TERMS = 4096          # terms of a tile at most
TILE_ITEMS = 256           # items of a tile
FOLD = 64                  # lists of tasks are first merged in so many groups per item
IMPACT = 1_000_000         # no impact is larger: tf * 10**9 div (1000 * tf + 20 * m) < 10**6

_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COMPACT_SCHEMA = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
FOUND_SCHEMA = "item int, doc_id bigint, score bigint, fold int"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text as UTF-8: runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TERM).split()


def compact(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has a term; ``vocabulary``: broadcast dict of term to number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            keep, n, sizes, terms, tfs = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                found = terms_of(text.as_py())
                if found:
                    held = Counter(t for t in map(known.get, found) if t is not None)
                    keep.append(i)
                    n.append(len(found))
                    sizes.append(len(held))
                    terms.extend(held.keys())
                    tfs.extend(held.values())
            at = pa.array(offsets_of(np.array(sizes, dtype=np.int64)), pa.int32())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(keep, pa.int64())), "n": pa.array(n, pa.int64()),
                "terms": pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                "tfs": pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))})

    return docs.mapInArrow(run, COMPACT_SCHEMA)


def document_frequencies(vectors: DataFrame, size: int) -> dict[int, int]:
    """The number of documents that hold each term of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for batch in batches:
            n += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
        has = np.flatnonzero(n)
        yield pa.record_batch({"term": has, "df": n[has]})

    counted = vectors.select("terms").mapInArrow(run, "term bigint, df bigint")
    return {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def item_groups(items: DataFrame, id_col: str, text_col: str, group_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in groups of at most ``group_terms`` terms."""
    plain = texts(items, id_col, text_col).groupBy("doc_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text"))
    held, size = [], 0
    for row in plain.orderBy("doc_id").toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if held and size + len(terms) > group_terms:
            yield held
            held, size = [], 0
        if terms:
            held.append((row["doc_id"], terms))
            size += len(terms)
    if held:
        yield held


class Tiles:
    """The items of a group as postings (items of a term), from which dense tiles are made."""

    def __init__(self, items: list[list[int]], weight: np.ndarray):
        pair = sorted((t, i) for i, ts in enumerate(items) for t in ts)
        term = np.array([t for t, _ in pair], dtype=np.int64)
        self.item = np.array([i for _, i in pair], dtype=np.int64)
        self.at = np.searchsorted(term, np.arange(len(weight) + 1))
        self.n_items, self.weight = len(items), weight.astype(np.float64)
        # the largest sum over the terms of a tile stays below 2**53
        self.terms = max(1, min(TILE_TERMS, (2 ** 53 - 1) // (IMPACT * max(1, int(weight.max(initial=1))))))

    def scores(self, n: np.ndarray, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
        """int64 scores, items x documents; document d holds terms[at[d]:at[d+1]]."""
        n_docs, n_words = totals
        m = 50 + (50 * n * n_docs) // n_words
        doc = np.repeat(np.arange(len(n)), np.diff(at))
        impact = ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc])).astype(np.float64)
        out = np.zeros((self.n_items, len(n)), dtype=np.int64)
        used, where = np.unique(terms, return_inverse=True)
        by_tile = np.argsort(where, kind="stable")
        edge = np.searchsorted(where[by_tile], np.arange(0, len(used) + self.terms, self.terms))
        for k, lo in enumerate(range(0, len(used), self.terms)):
            tile = used[lo:lo + self.terms]
            cells = by_tile[edge[k]:edge[k + 1]]
            right = np.zeros((len(tile), len(n)))
            right[where[cells] - lo, doc[cells]] = impact[cells]
            size = self.at[tile + 1] - self.at[tile]
            item, column = self.item[spread(self.at[tile], size)], np.repeat(np.arange(len(tile)), size)
            for first in range(0, self.n_items, TILE_ITEMS):
                here = (item >= first) & (item < first + TILE_ITEMS)
                left = np.zeros((min(TILE_ITEMS, self.n_items - first), len(tile)))
                left[item[here] - first, column[here]] = self.weight[tile[column[here]]]
                out[first:first + TILE_ITEMS] += (left @ right).astype(np.int64)
        return out


class Best:
    """For each item the first ``top`` documents met so far, by (score descending, doc_id ascending)."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, dtype=np.int64)
        self.item = self.doc = self.score = np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        item, column = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        item, doc, score = (np.r_[a, b] for a, b in ((self.item, item), (self.doc, docs[column]), (self.score, scores[item, column])))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        start = np.searchsorted(item, item)
        keep = np.arange(len(item)) - start < self.top
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        last = np.flatnonzero(np.arange(len(item)) - start == self.top - 1)
        self.floor[item[last]] = score[last]    # equal scores still come in: a smaller doc_id goes first


def search_group(docs: DataFrame, group: list[tuple[int | None, list[bytes]]], top: int) -> DataFrame:
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, ts in group for t in ts}))}
    vocabulary = spark.sparkContext.broadcast(number)
    vectors = settle(compact(docs, vocabulary))
    n_docs, n_words = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(vectors, len(number))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))], dtype=np.int64)
    shared = spark.sparkContext.broadcast(Tiles([[number[t] for t in ts] for _, ts in group], weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        tiles = shared.value
        best, none = Best(tiles.n_items, top), np.iinfo(np.int64).max
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_DOCS):
                block = batch.slice(first, BLOCK_DOCS)
                terms = block.column("terms")
                at = np.asarray(terms.offsets) - terms.offsets[0].as_py()
                found = tiles.scores(np.asarray(block.column("n")), at, np.asarray(terms.flatten(), dtype=np.int64),
                                     np.asarray(block.column("tfs").flatten(), dtype=np.int64), (n_docs, n_words))
                best.add(found, np.asarray(block.column("doc_id").fill_null(none)))
        doc = pa.array(best.doc, mask=best.doc == none)
        fold = TaskContext.get().partitionId() % FOLD
        yield pa.record_batch({"item": pa.array(best.item, pa.int32()), "doc_id": doc, "score": pa.array(best.score),
                               "fold": pa.array(np.full(len(best.item), fold), pa.int32())})

    found = vectors.mapInArrow(run, FOUND_SCHEMA)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for keys in (("item", "fold"), ("item",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(group)], "item int, item_id bigint")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 50, group_terms: int = GROUP_TERMS, id_col: str = "doc_id",
           text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``top`` documents of highest score above 0."""
    plain, out = texts(docs, id_col, text_col), None
    for group in item_groups(items, item_id_col, item_text_col, group_terms):
        found = search_group(plain, group, top)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
