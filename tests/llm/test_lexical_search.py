"""op12: scores and ranks against brute force and DuckDB, tiles, ties and bounds."""
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from llm_tables import docs
from seqlake.llm import lexical_search as ls
from seqlake.llm import queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, top):
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    merged = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in merged.items():
        found = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = 0
            for t in ts:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(1 for _, x in held if x[t]) + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def check(spark, rows, items, top=5, **kw):
    table = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, score int")
    got = ls.search(docs(spark, [(i, t, "s") for i, t in rows]), table, top=top, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items, top)


def sample(rng, n):
    stock = [f"w{i}" for i in range(40)] + ["É", "straße", "a_b", "x-1", "中文", "The"]
    return [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(0, 50)))) for i in range(n)]


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = sample(rng, 150) + [(None, "w1 w2"), (900, None), (901, ""), (902, "! ?"), (903, "w3 " * 20_000)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [rows[7]] * 4                       # copies, ties, repeated rows
    items = [(1, "w1 W2 the"), (2, None), (3, "nothing here"), (4, "w3 w3 w3"), (4, "É"), (None, "w9"), (7, rows[5][1] + " w1"), (8, "!")]
    check(spark, rows, items)
    check(spark, rows, items, group_terms=3)       # several passes
    for name, value in (("TILE_TERMS", 3), ("TILE_ITEMS", 2), ("BLOCK_DOCS", 7), ("FOLD", 2)):
        monkeypatch.setattr(ls, name, value)
    check(spark, rows, items, top=3)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ls.search(docs(spark, []), items).count() == 0
    assert ls.search(docs(spark, [(1, "a", "s")]), items.limit(0)).count() == 0
    check(spark, [(1, None), (2, "!!")], [(1, "a")])


def test_best_keeps_ties_by_id():
    best = ls.Best(1, 2)
    best.add(np.array([[5, 5, 5]]), np.array([30, 20, 10]))
    best.add(np.array([[5, 4, 0]]), np.array([1, 2, 3]))
    best.add(np.array([[9]]), np.array([99]))
    assert list(zip(best.doc.tolist(), best.score.tolist())) == [(99, 9), (1, 5)]


def test_tiles_stay_below_the_exact_range():
    weight = np.full(10, 2 ** 53 // (3 * ls.IMPACT))
    tiles = ls.Tiles([list(range(10))], weight)
    assert tiles.terms == 3 and tiles.terms * ls.IMPACT * int(weight.max()) < 2 ** 53
    n, tfs = np.array([10]), np.full(10, 10 ** 6)
    got = tiles.scores(n, np.array([0, 10]), np.arange(10), tfs, (1, 10))
    assert got.tolist() == [[10 * int(weight[0]) * (10 ** 15 // (10 ** 9 + 2000))]]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    name = "op12_lexical_search"
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, folder).collect())
    assert got == sorted(con.execute(queries.SQL[name]).fetchall()) and len(got) > 100
