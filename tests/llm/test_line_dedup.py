"""op6: units and passages against a plain version, hot digests, odd tables, clashing names, and DuckDB."""
import random
import re

import duckdb
import numpy as np
import pytest

from llm_tables import docs
from seqlake.llm import line_dedup as ld
from seqlake.llm import queries

BOUNDARY = re.compile("(?<=[ \t-\r])(?=[A-ZÀ-ÖØ-Þ])|(?<=\n)(?=[^ \t-\r])|(?<=[.!?][ \t-\r])(?=[^ \t-\r])")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def units(text):
    return BOUNDARY.split(text) if text else []


def form(unit):
    return [w for w in re.split("[ \t-\r]+", unit.translate(LOWER)) if w]


def brute(rows, min_words, min_bytes):
    """rows: (doc_id, text); returns (text, spans) of every row."""
    named = sorted({(i is None, i or 0, t or "") for i, t in rows})
    first = {}
    for null, i, text in named:
        for k, u in enumerate(units(text)):
            first.setdefault(tuple(form(u)), (null, i, text, k))
    out = []
    for i, t in rows:
        text, us, kept, spans, k, at = t or "", units(t or ""), [], [], 0, 0
        again = [first[tuple(form(u))] != (i is None, i or 0, text, n) for n, u in enumerate(us)]
        while k < len(us):
            e = k
            while e < len(us) and again[e]:
                e += 1
            sizes = [len(" ".join(form(u)).encode()) for u in us[k:e]]
            length = sum(map(len, us[k:e]))
            if e > k and (sum(len(form(u)) for u in us[k:e]) >= min_words or sum(sizes) >= min_bytes) \
                    and 2 * sum(x for x in sizes if x >= ld.CLEAR_BYTES) >= sum(sizes):
                spans.append((at, at + length))
            else:
                e = max(e, k + 1)
                kept += us[k:e]
                length = sum(map(len, us[k:e]))
            at += length
            k = e
        out.append(("".join(kept), spans))
    return out


def check(spark, rows, min_words=6, min_bytes=60):
    got = ld.dedup_units(docs(spark, [(i, t, "s") for i, t in rows]), min_words, min_bytes).collect()
    want = [(str(i), *x) for (i, _), x in zip(rows, brute(rows, min_words, min_bytes))]
    assert sorted((str(r["doc_id"]), r["text"], [tuple(s) for s in r["removed_spans"]]) for r in got) == sorted(want)
    assert all((r["size"], r["rid"], r["fp"]) == (7, 7, "x") for r in got)
    return want


def sample(rng, n):
    sentence = lambda: " ".join(rng.choice(["Der", "the", "a", "word", "été", "Été", "x" * 12, "longer", "×y"])
                                for _ in range(rng.randrange(1, 9))) + rng.choice([". ", "? ", " ", "\n", ".\n\n", "  ", ".\t", "!"])
    stock = [sentence() for _ in range(60)]
    return ["".join(rng.choice(stock) if rng.random() < 0.7 else sentence() for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_units_equal_a_plain_cut():
    rng = random.Random(1)
    texts = sample(rng, 80) + ["", " ", "\n\n", "  A b", "a.  B", "! ! ! b", "× À Þ ß", "x.\n\ny", "Q"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    got = ld.Units(data, at)
    for d, t in enumerate(texts):
        mine = range(got.at[d], got.at[d + 1])
        assert [bytes(data[got.begin[k]:got.end[k]]).decode() for k in mine] == units(t)
        assert [int(got.words[k]) for k in mine] == [len(form(u)) for u in units(t)]
        assert [int(got.size[k]) for k in mine] == [len(" ".join(form(u)).encode()) for u in units(t)]
    seen = {}
    for k, f in enumerate(tuple(form(u)) for t in texts for u in units(t)):
        assert seen.setdefault(f, got.digest[k]) == got.digest[k]
    assert len(set(seen.values())) == len(seen)


def test_passages_against_brute_force(spark):
    rng = random.Random(2)
    texts = sample(rng, 150)
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (None, texts[3]), (None, None), (502, " \n"), (503, texts[5] * 300)]
    rows += [(600, texts[7])] * 3 + [(601, texts[7]), (7, texts[9])]
    want = check(spark, rows)
    assert sum(bool(x[2]) for x in want) > 40
    check(spark, rows, min_words=25, min_bytes=10_000)


def test_hot_digests_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT_ROWS", 20)
    monkeypatch.setattr(ld, "FEW_HOT", 10 ** 9)
    rng = random.Random(3)
    common = "This very line stands in every one of the documents here.\n"
    check(spark, [(i, t + common) for i, t in enumerate(sample(rng, 120))])


def test_passage_inside_a_line_goes_and_short_ones_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(" ".join([word().capitalize(), *(word() for _ in range(8))]) + "." for _ in range(6))      # 54 words
    lead, tail, licence = (" ".join(word() for _ in range(12)) for _ in range(3))
    chinese = "天地玄黃" * 40                                                                        # one word, 480 bytes
    rows = [(1, passage), (2, f"{lead} {passage} {tail}\n{licence}"), (3, f"{licence}\nown words"), (4, chinese), (5, f"a\n{chinese}\nb")]
    got = {r["doc_id"]: (r["text"], [tuple(s) for s in r["removed_spans"]])
           for r in ld.dedup_units(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    n = len(lead) + 1
    assert got[2] == (f"{lead} {tail}\n{licence}", [(n, n + len(passage) + 1)])
    assert got[5] == ("a\nb", [(2, 2 + len(chinese) + 1)])
    assert all(got[i] == (dict(rows)[i], []) for i in (1, 3, 4))


def test_names_of_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "x", 9, "a"), (2, "x", 8, "b")], "doc_id bigint, text string, Removed_Spans int, cut_id string")
    got = ld.dedup_units(df)
    assert got.columns == ["doc_id", "text", "Removed_Spans", "cut_id", "removed_spans_"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, "x", 9, "a"), (2, "x", 8, "b")]
    assert ld.dedup_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_registered_query(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op6_line_dedup"](spark, folder).collect())
    assert got == sorted(con.execute(queries.SQL["op6_line_dedup"]).fetchall()) and any(r[2] for r in got)
