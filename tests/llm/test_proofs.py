"""Operators whose results SQL cannot say, against plain versions: op1, op3, op9."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import docs
from seqlake.llm import mixing, quality, queries, simhash_fingerprint

FOLDER = "/root/testdata/sf0.001"


def sample(rng, n):
    words = ["the", "cat", "sat", "mat", "on", "a", "very", "long", "word", "été", "THE"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_simhash_bits_are_the_weighted_majority(spark):
    """op3: every bit of every fingerprint by a plain vote over the terms, whose hashes Spark gives."""
    texts = sample(random.Random(1), 40) + ["", " \t\n", "one", "Ab  ab\nAB ab"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["fp"] for r in simhash_fingerprint.fingerprints(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    pairs = set()
    terms = {}
    for i, t in rows:
        w = [x for x in t.lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        terms[i] = [(a, b) for a, b in zip(w, [*w[1:], None])]
        pairs |= set(terms[i])
    hashes = {(r["a"], r["b"]): r["h"] & (1 << 64) - 1 for r in spark.createDataFrame(sorted(pairs, key=str), "a string, b string").select(
        "a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for i, _ in rows:
        total = sum(len(a.encode()) for a, _ in terms[i])
        want = 0
        for j in range(64):
            if 2 * sum(len(a.encode()) for a, b in terms[i] if hashes[a, b] >> j & 1) > total:
                want |= 1 << j
        assert got[i] & (1 << 64) - 1 == want


def test_block_tables_find_every_near_fingerprint(spark):
    """op3: counts within three bits are those of brute force (recall and precision of 1)."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12)
    fps = [int(b) for b in base for _ in range(3)]
    for b in base:
        for bits in (1, 2, 3, 4, 5):
            x = int(b)
            for j in rng.choice(64, bits, replace=False):
                x ^= 1 << int(j)
            fps.append(x - (1 << 64) if x >> 63 else x)
    table = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    got = {r["fp"]: r["n_near"] for r in simhash_fingerprint.near_counts(table, table, radius=3).collect()}
    close = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    assert got == {x: sum(close(x, y) for y in fps) for x in set(fps)}


def test_registered_fingerprints(spark):
    """op3 over a whole table: edited texts, likeness and neighbours."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_simhash_fingerprints"](spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    for i, j in zip(ids, ids[1:] + ids[:1]):
        n, r = len(texts[i]), got[i]
        edited = texts[i][:n - n // 2] + texts[j][:n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == like(r["fingerprint"], got[j]["fingerprint"])
        if i % 20 == 0:
            assert r["n_within_3_bits"] == sum(like(r["fingerprint"], x["fingerprint"]) >= 1 - 3 / 64 for x in got.values()) - 1


def test_mix_takes_the_words_of_its_slots(spark):
    """op9: sources are laid end to end without gaps, and what is taken of a document is counted word by word."""
    rng = random.Random(3)
    rows = [(k, k % 70 if k % 9 else None, rng.choice(["a", "b", None]), rng.choice([0, 1, 5, 31, 32, 33, 400])) for k in range(200)]
    m = mixing.mix(spark.createDataFrame(rows, "rid bigint, doc_id bigint, source string, size bigint"), block_words=32)
    laid = m.documents.collect()
    names = {r["source_no"]: r for r in m.sources.collect()}
    times = {}
    for r in m.slots.collect():
        times[r["source_no"], r["block"]] = times.get((r["source_no"], r["block"]), 0) + 1
    words = {}
    for no, s in names.items():
        at = 0
        for r in sorted((r for r in laid if r["source_no"] == no and r["size"]), key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["size"]
            words[r["rid"]] = sum(times.get((no, w // 32), 0) for w in range(r["start"], at))
        assert at == s["source_size"]
    got = {r["rid"]: r["taken"] for r in mixing.taken_words(m).collect()}
    assert got == {k: words.get(k, 0) for k, *_ in rows}
    for no in names:      # a pass takes every block at most once, and the passes before the last one all of them
        blocks = -(-names[no]["source_size"] // 32)
        mine = [n for (s, _), n in times.items() if s == no]
        assert all(b < blocks for s, b in times if s == no) and (not mine or max(mine) - min(mine + [0] * (len(mine) < blocks)) <= 1)


def test_registered_mix(spark):
    got = queries.QUERIES["op9_source_mixing"](spark, FOLDER).collect()
    texts = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    total = sum(n for _, n in texts.values())
    assert {r["doc_id"]: r["size"] for r in got} == {i: n for i, (_, n) in texts.items()}
    sources = {s: (sum(r["taken"] for r in got if texts[r["doc_id"]][0] == s), next(r["target"] for r in got if texts[r["doc_id"]][0] == s))
               for s in {s for s, _ in texts.values()}}
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total)
    assert all(abs(a - t) <= 32 + 0.02 * t for a, t in sources.values()) and all(r["taken"] <= 2 * r["size"] for r in got)
    again = queries.QUERIES["op9_source_mixing"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_classifier_on_labels_it_has_not_seen(spark):
    """op1: fitted on one half of the labels, judged on the other; site rates are shrunk sums of the documents' evidence."""
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(table, labels.where("doc_id % 4 < 2")).collect()}
    unseen = [(got[r["doc_id"]]["keep"], r["quality"]) for r in labels.where("doc_id % 4 >= 2").collect()]
    good, bad = [k for k, q in unseen if q == 1], [k for k, q in unseen if q == 0]
    assert len(good) > 50 and len(bad) > 10
    assert sum(good) / len(good) > 0.97 and sum(not k for k in bad) / len(bad) > 0.8
    for r in got.values():
        site = min(max(r["path_rate"], 1e-6), 1 - 1e-6)
        assert r["p_good"] == pytest.approx(1 / (1 + math.exp(-(r["evidence"] + math.log(site / (1 - site))))))
        assert 0 < r["host_rate"] < 1 and r["keep"] == (r["p_good"] >= 0.5)
