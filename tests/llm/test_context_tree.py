"""op8: whole scores against a plain context-tree weighting, blocks and shards of any size, odd tables."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from llm_tables import docs
from seqlake.llm import context_tree as ct
from seqlake.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").translate(LOWER).encode().split()


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def stream(text):
    return b" ".join(words(text)) + b"\n"


class PlainTree:
    """Nodes (context, decision) in a dictionary; contexts are the bytes before, nearest first."""

    def __init__(self, streams, depth):
        self.depth, self.n, self.below = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for s in streams:
            for i in range(len(s)):
                for context, number, bit in self.path(s, i):
                    self.n[context, number][bit] += 1
                    if context:
                        self.below[context[:-1], number].add(context)
        self.log_w = {}
        for node in sorted(self.n, key=lambda x: -len(x[0])):
            z, o = self.n[node]
            kt = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
            if len(node[0]) == depth:
                self.log_w[node] = (kt, kt)
            else:
                rest = sum(self.log_w[c, node[1]][1] for c in self.below[node])
                self.log_w[node] = (kt, math.log(0.5) + np.logaddexp(kt, rest))

    def path(self, s, i):
        before = (b"\n" * self.depth + s[:i])[::-1][:self.depth]
        for k in range(8):
            for d in range(self.depth + 1):
                yield before[:d], 1 << k | s[i] >> (8 - k), s[i] >> (7 - k) & 1

    def log10(self, s):
        total = 0.0
        for i in range(len(s)):
            path = list(self.path(s, i))
            for k in range(8):
                p = None
                for context, number, bit in reversed(path[k * (self.depth + 1):(k + 1) * (self.depth + 1)]):
                    if (context, number) in self.n:
                        z, o = self.n[context, number]
                        own = ((z, o)[bit] + 0.5) / (z + o + 1)
                        kt, w = self.log_w[context, number]
                        stop = math.exp(math.log(0.5) + kt - w) if len(context) < self.depth else 1.0
                        p = own if p is None else stop * own + (1 - stop) * p
                total += math.log10(0.5 if p is None else p)
        return total


def brute(rows, depth):
    train = [t for i, t in rows if not held_out(i)]
    tree = PlainTree([stream(t) for t in train], depth)
    count = Counter(w for t in train for w in [*words(t), None])
    total = sum(count.values())
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tokens)
        out.append((str(i), held_out(i), len(tokens), sum(count[w] > 0 for w in tokens), total, base, tree.log10(stream(t))))
    return out


def check(spark, rows, depth=ct.DEPTH):
    got = ct.score(docs(spark, [(i, t, "s") for i, t in rows]), depth).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    want = sorted(brute(rows, depth))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=1e-5)


def sample(rng, n):
    return [(i, " ".join(rng.choice(["The", "cat", "sat", "été", "on", "a", "mat", "dog", "xyz"]) for _ in range(rng.randrange(0, 12)))) for i in range(n)]


ODD = [(None, "No id"), (None, None), (901, ""), (902, " \n\t "), (903, "  lead  and trail \n"), (904, "cat " * 300), (905, "中文 q"), (905, "中文 q")]


@pytest.mark.parametrize("depth", [6, 2])
def test_scores_equal_a_plain_context_tree(spark, depth):
    check(spark, sample(random.Random(1), 40) + ODD, depth)


def test_many_blocks_pieces_and_shards(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 300), ("PIECE", 64), ("SHARD_BYTES", 100), ("MERGE_AT", 50), ("PART_BYTES", 40), ("SLICE_BYTES", 50)):
        monkeypatch.setattr(ct, name, value)
    check(spark, sample(random.Random(2), 40) + ODD)


def test_without_training_and_without_rows(spark):
    out = [i for i in range(200) if held_out(i)][:3]
    check(spark, [(i, "unseen text") for i in out])
    check(spark, [(i, t) for i, t in sample(random.Random(3), 20) if not held_out(i)])
    assert ct.score(docs(spark, [])).count() == 0


def test_context_reaches_six_bytes(spark):
    """The byte that tells the next one apart is the sixth before it: five bytes cannot, six can."""
    rows = [(i, f"{c}aaaaa{c}" * 3, "s") for i in range(60) for c in "xy"]
    scores = [sum(r["score"] for r in ct.score(docs(spark, rows), d).collect() if r["held_out"]) for d in (6, 5)]
    assert scores[0] > 0.7 * scores[1]    # logarithms: less is worse


def test_probabilities_of_all_bytes_sum_to_one():
    data = np.frombuffer(b"abab\nabba\n", np.uint8)
    keys, n = ct.gram_counts(data, np.array([0, 5, 10]), 10, 2)
    levels = ct.mixed(ct.build(keys, n, 2, 0))
    for context in (b"ab", b"\n\n", b"zz", b"az"):
        every = np.array([context[1] << 16 | context[0] << 8 | b for b in range(256)])
        assert (10 ** ct.log10_probability(every, levels)).sum() == pytest.approx(1)


def test_packed_arrays():
    rng = np.random.default_rng(4)
    for a in (np.zeros(0, np.int64), np.array([-5, 7]), rng.integers(-2 ** 62, 2 ** 62, 1000)):
        assert (ct.unpacked(ct.packed(a)) == a).all() and (ct.unpacked(ct.packed(np.sort(a), True), True) == np.sort(a)).all()


    x = np.r_[-rng.random(500) * 9, 0.0]
    assert ct.unpacked_floats(ct.packed_floats(x)) == pytest.approx(x, rel=1e-6) and len(ct.unpacked_floats(ct.packed_floats(x[:0]))) == 0


def test_session_setting_is_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    ct.score(docs(spark, [(1, "a b", "s")])).count()
    assert spark.conf.get(key) == before


def test_registered_query(spark):
    """Base scores and counts of a whole table, and held-out texts in far fewer than eight bits a byte."""
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    count = Counter(w for i, t in rows if not held_out(i) for w in [*words(t), None])
    total = sum(count.values())
    want = {i: (held_out(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), total) for i, t in rows}
    got = queries.QUERIES["op8_context_tree_scoring"](spark, folder).collect()
    assert {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == want
    for r in got[::20]:
        t = dict(rows)[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in [*words(t), None]))
    bits = -sum(r["score"] for r in got if r["held_out"]) * math.log2(10)
    assert bits < 3.5 * sum(len(stream(t)) for i, t in rows if held_out(i))
