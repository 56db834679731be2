"""Source divergence audit: token-start pointer sort.

Each task keeps its documents as Arrow buffers. Documents of a slice are ordered by (lang, source)
and a pointer is set on the first byte of every term. A multikey quicksort orders the pointers by
what they point at: the characters compared at a time are eight bytes, and every slice of pointers
that are equal so far is sorted by its next eight until it holds one term. A run of equal pointers
is one term; inside a run pointers stay in buffer order, so documents and sources lie together
and the run gives the term's document frequency and its count in every source. Slices are summed
by Spark over the whole corpus.

The audit compares smoothed rates p of the terms that a lang keeps (those in ``min_docs`` of its
documents): between every two sources of a lang (part ``pair``) and between a source and its lang
(part ``term``, the ``top`` terms that the source has too often). Pair sums come from blocks of
terms times blocks of sources, as partial sums of each task, never as pairs of rows.

Defined results: a null text, lang or source is ''; repeated rows count each; a text without terms
still makes its (lang, source) occur; a lang that keeps no term has pair rows of value 0 and no
term rows; an empty table gives an empty table; other columns are ignored. Terms are compared as
UTF-8 bytes. The driver and the broadcast hold one row per (lang, source): the result has a row
for every two sources of a lang, so this list is at most about the root of what is returned.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import same
from seqlake.llm.ragged import byte_slices, offsets_of, spread, text_buffer
from seqlake.session import settle

SLICE_BYTES = 6 << 20      # of text whose pointers are sorted together
SOURCE_BLOCK = 512         # sources of a lang whose pair sums one matrix holds
MATRICES = 32              # of a task, before they are sent on
CELLS = 1 << 19            # of a block of terms times sources
SCALE = 1_000_000_000

TERM_BYTE = np.zeros(256, dtype=bool)
TERM_BYTE[0x41:0x5B] = TERM_BYTE[0x61:0x7B] = TERM_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASK = np.array([0] + [(0xFFFFFFFFFFFFFFFF << 8 * (8 - n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], dtype=np.uint64)


def term_pointers(data: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, length) of every term in ``data``; ``doc_at`` has the beginnings of the documents and the end."""
    inside = TERM_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = doc_at[(doc_at > 0) & (doc_at < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    at = np.flatnonzero(first)
    return at, np.flatnonzero(last) + 1 - at


def multikey_sort(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): the pointers ordered by their terms, and whether each begins a run of equal terms.
    Eight bytes at a time: a slice of equal pointers is sorted by its next eight bytes while these differ."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = LOWER[data]
    eight = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded, strides=(1,))

    def key(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(length[which] - 8 * depth, 0, 8)
        return eight[np.minimum(at[which] + 8 * depth, len(data))].astype(np.uint64) & _MASK[left]

    now = key(slice(None), 0)
    order = np.argsort(now)
    now = now[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = now[1:] != now[:-1]
    open_ = np.flatnonzero((now & np.uint64(255)) != 0)       # places whose term goes on after these eight bytes
    depth = 1
    while len(open_):
        run = np.cumsum(fresh[open_])                          # pointers of a run lie together and are all open
        alone = fresh[open_] & np.r_[run[1:] != run[:-1], True]
        open_, run = open_[~alone], run[~alone]
        if not len(open_):
            break
        now = key(order[open_], depth)
        within = np.lexsort((now, run))
        order[open_], now = order[open_][within], now[within]
        fresh[open_[1:]] |= (run[1:] == run[:-1]) & (now[1:] != now[:-1])
        open_ = open_[(now & np.uint64(255)) != 0]
        depth += 1
    return order, fresh


def slice_counts(langs: np.ndarray, sources: np.ndarray, text: pa.Array) -> pa.Table | None:
    """(lang, source, term, n, df) of a slice of whole documents."""
    names, group = np.unique(np.array([langs, sources]), axis=1, return_inverse=True)
    group = group.reshape(-1)
    by_group = np.argsort(group, kind="stable")
    data, doc_at = text_buffer(text.take(pa.array(by_group)))
    at, length = term_pointers(data, doc_at)
    if not len(at):
        return None
    order, fresh = multikey_sort(data, at, length)
    run = np.cumsum(fresh) - 1
    place = np.sort(run << 32 | order)                         # equal terms in buffer order
    run, order = place >> 32, place & 0xFFFFFFFF
    words = np.diff(np.searchsorted(at, doc_at))
    doc = np.repeat(np.arange(len(words)), words)[order]
    of = group[by_group][doc]
    new_run = np.r_[True, run[1:] != run[:-1]]
    new_doc = new_run | np.r_[True, doc[1:] != doc[:-1]]
    new_group = np.flatnonzero(new_run | np.r_[True, of[1:] != of[:-1]])
    n = np.diff(np.r_[new_group, len(run)])
    df = np.add.reduceat(new_doc.astype(np.int64), new_group)
    head = order[new_run]                                      # a pointer of every run
    letters = LOWER[data[spread(at[head], length[head])]]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [
        None, pa.py_buffer(offsets_of(length[head])), pa.py_buffer(letters)]).cast(pa.large_string())
    take = pa.array(of[new_group])
    lang, source = (pa.array(x).take(take) for x in names)
    return pa.table({"lang": lang.cast(pa.string()), "source": source.cast(pa.string()),
                     "term": terms.take(pa.array(run[new_group])).cast(pa.string()), "n": n, "df": df})


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df) of every term over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", SLICE_BYTES):
            part = part.combine_chunks()
            out = slice_counts(*(np.array(part.column(c).to_pylist(), dtype=object).astype(str) for c in ("lang", "source")),
                               part.column("text").combine_chunks())
            if out is not None:
                yield from out.to_batches(max_chunksize=1 << 17)

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                          for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    return (plain.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


def rate(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / total) in steps that stay inside 64 bits (n + 2 <= total < 2**53)."""
    rest, out = n + 2, np.zeros(np.broadcast(n, total).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def rate_column(n: Column, total: Column) -> Column:
    """The same as a column expression."""
    scaled = (F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)"))
    return F.call_function("div", scaled, total.cast("decimal(19,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(kept: DataFrame, totals: dict[str, tuple[list[str], list[int]]]) -> DataFrame:
    """(lang, a, b, value): f summed over the lang's kept terms, for sources numbered a < b within their lang."""
    sc = kept.sparkSession.sparkContext
    known = sc.broadcast({lang: ({s: i for i, s in enumerate(names)}, np.array(total, dtype=np.int64))
                          for lang, (names, total) in totals.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def sent():
            for (lang, x, y), m in sums.items():
                a, b = np.nonzero(np.ones_like(m, dtype=bool))
                a, b, value = a + x, b + y, m.reshape(-1)
                up = a < b
                yield pa.record_batch({"lang": pa.array([lang] * int(up.sum()), pa.string()), "a": a[up], "b": b[up], "value": value[up]})
            sums.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            lists = batch.column("by_source")
            at = np.asarray(lists.offsets)
            names, ns = lists.values.field(0).to_pylist(), np.asarray(lists.values.field(1))
            for lang in dict.fromkeys(langs):
                number, total = known.value[lang]
                rows = [i for i, x in enumerate(langs) if x == lang]
                blocks = range(0, len(total), SOURCE_BLOCK)
                step = max(1, CELLS // max(1, min(len(total), SOURCE_BLOCK)))
                for k in range(0, len(rows), step):
                    part = np.array(rows[k:k + step])
                    cells = spread(at[part], at[part + 1] - at[part])
                    row = np.repeat(np.arange(len(part)), at[part + 1] - at[part])
                    col = np.array([number[names[i]] for i in cells.tolist()], dtype=np.int64)
                    p = {}
                    for x in blocks:
                        here = (col >= x) & (col < x + SOURCE_BLOCK)
                        n = np.zeros((len(part), min(SOURCE_BLOCK, len(total) - x)), dtype=np.int64)
                        n[row[here], col[here] - x] = ns[cells[here]]
                        p[x] = rate(n, total[None, x:x + SOURCE_BLOCK])
                    for x in blocks:
                        for y in blocks[x // SOURCE_BLOCK:]:
                            if (lang, x, y) not in sums and len(sums) >= MATRICES:
                                yield from sent()
                            m = sums.setdefault((lang, x, y), np.zeros((p[x].shape[1], p[y].shape[1]), dtype=np.int64))
                            for a in range(p[x].shape[1]):
                                one = p[x][:, a:a + 1]
                                m[a] += ((one - p[y]) ** 2 // (one + p[y])).sum(axis=0)
        yield from sent()

    return (kept.select("lang", "by_source").mapInArrow(run, "lang string, a bigint, b bigint, value bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): see above."""
    spark = docs.sparkSession
    counts = term_counts(docs, text_col, lang_col, source_col)
    kept = settle(counts.groupBy("lang", "term")
                  .agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by_source"))
                  .where(F.col("df") >= min_docs).drop("df"))
    present = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col)))).distinct()
    single = kept.select("lang", "term", "n", F.explode("by_source").alias("s")).select(
        "lang", "term", F.col("n").alias("lang_n"), F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    of_group = single.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    found = {r["lang"]: r for r in of_lang.collect()}
    totals: dict[str, tuple[list[str], list[int]]] = {}
    rows = present.join(of_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).collect()
    for r in sorted(rows, key=lambda r: (r["lang"], r["source"])):
        names, total = totals.setdefault(r["lang"], ([], []))
        names.append(r["source"])
        total.append(r["n"] + 2 * (found[r["lang"]]["v"] if r["lang"] in found else 0))
    groups = spark.createDataFrame(
        [(lang, s, i, t, found[lang]["n"] + 2 * found[lang]["v"] if lang in found else 0)
         for lang, (names, total) in totals.items() for i, (s, t) in enumerate(zip(names, total))],
        "lang string, source string, number bigint, total bigint, lang_total bigint")

    p, q = rate_column(F.col("n"), F.col("total")), rate_column(F.col("lang_n"), F.col("lang_total"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (single.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
             .where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", excess(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    sums = settle(pair_sums(kept, totals))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    mine = groups.select("lang", "source", F.col("number").alias("a"))
    other = groups.select(F.col("lang").alias("lang2"), F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = (mine.join(other, same((F.col("lang"), F.col("lang2")))).where("a <> b").drop("lang2").join(both, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
             .withColumn("rank", F.row_number().over(order)))
    return pairs.unionByName(terms)
