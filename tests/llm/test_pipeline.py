"""Every stage of the pipeline against what its operator says of the rows it was given, odd rows and clashing names included."""
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from seqlake.llm import line_dedup, quality, simhash_dedup

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(cp.STAGES)
# further columns under names the operators use inside
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, rid int, bad_id int, removed_spans int, cut_units int, part_text int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3, 4, 5, 6) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join([word().capitalize(), *(word() for _ in range(8))]) + "."
    passage = " ".join(sentence() for _ in range(7))
    out = [(i, " ".join(sentence() for _ in range(rng.randrange(1, 12))), f"s{i % 3}") for i in range(60)]
    out += [(100 + i, out[0][1], "s1") for i in range(10)]                                        # copies
    out += [(200 + i, " ".join([sentence(), passage, sentence()]), "s2") for i in range(5)]       # a shared passage
    return out + [(300, None, None), (301, "", "s1"), (302, " \n", "s1"), (None, "No id here.", "s1"), (303, out[1][1], "s0"), (303, out[2][1], "s0"),
                  (304, " ".join(sentence() for _ in range(600)), None)]


def same_columns(got, df):
    assert got.columns == df.columns and [t for c, t in got.dtypes if c != "text"] == [t for c, t in df.dtypes if c != "text"]


def test_quality_stage(spark, rows):
    df = table(spark, rows)
    got = STAGES["quality_classifier"](spark, df, FOLDER)
    same_columns(got, df)
    keep = Counter((r["doc_id"], r["text_hash"]) for r in quality.classify(df, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("keep").collect())
    hashed = got.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    assert Counter((r["doc_id"], r["h"]) for r in hashed.collect()) == keep


def test_near_dedup_stage(spark, rows):
    df = table(spark, rows)
    got = STAGES["simhash_near_dedup"](spark, df, FOLDER)
    same_columns(got, df)
    prints = [(i, simhash_dedup.simhash(t or "", 3), t) for i, t, _ in rows]
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                group[root(a)] = root(b)
    members = defaultdict(list)
    for k, (i, _, t) in enumerate(prints):
        members[root(k)].append((i is None, i or 0, t))
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(kept) == len(members)
    best = [min(m, key=lambda x: x[:2]) for m in members.values()]
    assert sorted((i is None, i or 0) for i, _ in kept) == sorted(b[:2] for b in best)


def test_substring_stage(spark, rows):
    df = table(spark, rows)
    got = STAGES["substring_dedup"](spark, df, FOLDER)
    same_columns(got, df)
    want = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_units(df).collect())
    out = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == want and all(r["n_chars"] == len(r["text"]) for r in out)
    texts = {r["doc_id"]: r["text"] for r in out if r["doc_id"] is not None}
    before = {i: t for i, t, _ in rows}
    assert texts[200] == before[200] and all(len(texts[200 + i]) < 0.5 * len(before[200 + i]) for i in range(1, 5))
    assert all(texts[i] == before[i] for i in range(60)) and texts[300] == "" and all(r["removed_spans"] == 4 for r in out)


def test_mixing_stage(spark, rows):
    df = table(spark, rows)
    got = STAGES["source_mixing"](spark, df, FOLDER)
    same_columns(got, df)
    out, total = got.collect(), sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(len(r["text"].split()) for r in out) - 1.5 * total) <= 100 and all(r["n_chars"] == len(r["text"]) for r in out)
    words = defaultdict(Counter)
    for i, t, _ in rows:
        words[i].update((t or "").split())
    taken = defaultdict(Counter)
    for r in out:
        taken[r["doc_id"]].update(r["text"].split())
    assert all(n <= 2 * words[i][w] for i, c in taken.items() for w, n in c.items())


def test_packing_stage(spark, rows):
    got = STAGES["best_fit_packing"](spark, table(spark, rows), FOLDER).collect()
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and {r["doc_id"] for r in got} == {i for i, _, _ in rows}
    assert sum(r["piece"] == 0 for r in got) == len(rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables_pass_through(spark, rows, name):
    none = table(spark, rows).limit(0)
    got = STAGES[name](spark, none, FOLDER)
    assert got.count() == 0 and (name == "best_fit_packing" or got.columns == none.columns)


def test_whole_run(spark):
    """The stages one after the other over a whole table: rows of the last one come from documents that all the others kept."""
    out = cp.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r["doc_id"] for r in STAGES["simhash_near_dedup"](spark, STAGES["quality_classifier"](spark, docs, FOLDER), FOLDER).collect()}
    assert {r["doc_id"] for r in out} <= kept and len({r["doc_id"] for r in out}) > 0.5 * len(kept)
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
