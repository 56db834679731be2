"""op11: pointers and runs against plain sorting, the audit against brute force and DuckDB."""
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from llm_tables import docs
from seqlake.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    count, df, out = defaultdict(Counter), defaultdict(Counter), []
    for t, g, s in rows:
        count[g, s].update(terms(t))
        df[g].update(set(terms(t)))
    for lang in {g for _, g, _ in rows}:
        kept = [w for w, n in df[lang].items() if n >= min_docs]
        groups = {s: count[lang, s] for s in {s for _, g, s in rows if g == lang}}
        whole = Counter()
        for c in groups.values():
            whole.update({w: c[w] for w in kept})

        def rates(c):
            total = sum(c[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // total for w in kept}

        p = {s: rates(c) for s, c in groups.items()}
        q = rates(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            parts = {"pair": [(x, sum(f(p[s][w], p[x][w]) for w in kept)) for x in groups if x != s],
                     "term": [(w, f(p[s][w], q[w])) for w in kept if groups[s][w] > 0 and p[s][w] > q[w]]}
            for part, items in parts.items():
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def check(spark, rows, min_docs=3, top=4):
    table = docs(spark, [(i, t, s, g) for i, (t, g, s) in enumerate(rows)])
    got = divergence.audit(table, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_docs, top)


def sample(rng, n, langs=("en", "de"), sources=("a", "b", "c", None)):
    stock = ["a", "B", "straße", "Éa", "wordlongerthaneight", "wordlongerthaneighT", "wordlongerthanEighteen", "abcdefgh", "abcdefghi", "ABCDEFGHabcdefgh",
             "中文", "日", "x_y", "a1b", "don't"] + [f"t{chr(97 + i)}" for i in range(12)]
    return [(" ".join(rng.choice(stock) for _ in range(rng.randrange(0, 40))), rng.choice(langs), rng.choice(sources)) for _ in range(n)]


def test_pointers_runs_and_order():
    rng = random.Random(2)
    for n in (0, 1, 5, 200):
        batch = [t for t, _, _ in sample(rng, n)] + ["", "zz", "Zz"]
        raw = [t.encode() for t in batch]
        data = np.frombuffer(b"".join(raw), np.uint8)
        doc_at = np.cumsum([0] + [len(r) for r in raw])
        at, length = divergence.term_pointers(data, doc_at)
        found = [bytes(data[a:a + k]).decode() for a, k in zip(at, length)]
        assert found == [w for t in batch for w in TERM.findall(t)]
        order, fresh = divergence.multikey_sort(data, at, length)
        ordered = [found[i].translate(LOWER).encode() for i in order]
        assert sorted(order) == list(range(len(found))) and ordered == sorted(ordered)
        assert fresh.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(len(ordered))]


def test_rates_are_exact():
    for n, total in ((0, 4), (999_999_999_998, 10 ** 12), (123_456_789_012, 987_654_321_987_654), (7, 9)):
        assert int(divergence.rate(np.array([n]), np.array([total]))[0]) == 1 + 1_000_000_000 * (n + 2) // total


def test_audit_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = sample(rng, 150) + [(None, "fr", "only"), ("", None, None), ("lone", "es", "x"), ("lone", "es", "y"), (None, "en", "empty")]
    rows += [rows[0]] * 30 + [("hot " * 30_000, "en", "a")]
    check(spark, rows)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 300)    # many slices, blocks of sources, matrices sent on early
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(divergence, "MATRICES", 2)
    monkeypatch.setattr(divergence, "CELLS", 8)
    check(spark, sample(rng, 80, sources=("a", "b", "c", "d", "e")) + [("t", "en", f"s{i}") for i in range(3)])


def test_no_kept_term_and_empty_table(spark):
    check(spark, [("one", "en", "a"), ("two", "en", "b"), (None, "en", "c")])
    assert divergence.audit(docs(spark, [])).count() == 0


def test_ties_rank_by_bytes(spark):
    rows = [("z é a", "en", "s1")] * 3 + [("q", "en", "s2")] * 3 + [("q", "en", "é")] * 3 + [("q", "en", "z")] * 3
    check(spark, rows, top=2)


def test_slice_counts_of_sliced_arrays():
    text = pa.array(["skip me", "B b a", "a", "c"]).slice(1)
    got = divergence.slice_counts(np.array(["x", "x", "y"]), np.array(["s", "t", "s"]), text).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == [("x", "s", "a", 1, 1), ("x", "s", "b", 2, 1), ("x", "t", "a", 1, 1), ("y", "s", "c", 1, 1)]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    name = "op11_source_divergence_audit"
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, folder).collect())
    assert got == sorted(con.execute(queries.SQL[name]).fetchall()) and len(got) > 100
