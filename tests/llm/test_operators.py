"""The training-data operators against brute force, and their defined results on odd input."""
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlake.llm import (common, context_tree, lattice_dedup, line_dedup, mixing, packing, quality, simhash_dedup, simhash_fingerprint,
                         token_counts, url_filter)
from seqlake.session import settle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size int, rid int"


def docs(spark, rows):
    """Documents with null columns, and further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 7, 7) for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=50):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 60)), f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[0][1], "s0") for i in range(40)]                   # copies
    rows += [(300, None, None), (301, "", "s1"), (302, " \n\t ", "s9"), (None, "no id", "s1"), (303, words(rng, 30_000), "s2"),
             (304, "É <|endoftext|> x\u00a0y\n\n", "s1"), (304, "É <|endoftext|> x\u00a0y\n\n", "s1")]
    return rows


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.classify(none, labels).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_fingerprint.fingerprints(none).count() == 0
    assert line_dedup.dedup_units(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert packing.pack(packing.pieces(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert context_tree.score(none).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string"), [("block", "net/")]).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert lattice_dedup.near_duplicates(vectors).count() == 0


def test_quality_without_and_with_labels(spark, corpus):
    df = docs(spark, corpus)
    got = quality.classify(df, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(got) == len(corpus) and all(r["keep"] for r in got)
    junk = [(1000 + i, "aa " * (20 + i), "s1") for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(1000 + i, 0) for i in range(40)] + [(None, 0), (5, None)],
                                   "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(docs(spark, corpus[:120] + junk), labels).collect()}
    assert len(kept & set(range(120))) >= 118 and len(kept & set(range(1040, 1060))) <= 1


def test_site_rates_shrink_to_the_global_rate(spark):
    sites = spark.createDataFrame([(90.0, 100), (10.0, 100), (1.0, 1)], "good double, n bigint")
    weak = quality.prior_weight(sites, F.lit(0.5))
    same = quality.prior_weight(spark.createDataFrame([(50.0, 100), (49.0, 100)], "good double, n bigint"), F.lit(0.5))
    assert weak < 10 < same


def test_lattice(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * 2
    points = np.concatenate([x * 0 + np.rint(x), lattice_dedup.decode_e8(x)])
    best = ((x - lattice_dedup.decode_e8(x)) ** 2).sum(axis=1)
    table, squares = lattice_dedup.neighbours()
    assert len(table) == 2400 and set(squares) == {2, 4} and best.max() <= 1 + 1e-9 and len(points) == 600
    for v in table[::97]:    # no lattice point near the decoded one is closer
        assert (((x - lattice_dedup.decode_e8(x) - v) ** 2).sum(axis=1) >= best - 1e-9).all()


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "CELL_ROWS", 8)    # chunked cells too
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 24))
    rows = [(i, (base[i % 6] + rng.normal(size=24) * 0.15 * (i % 4)).tolist(), i % 2) for i in range(160)]
    rows += [(500 + i, rows[0][1], 0) for i in range(5)] + [(600, None, 0), (601, [0.0] * 24, 0), (602, [1.0, None], 0),
                                                            (603, rows[0][1], None), (604, [float("nan")] * 24, 0), (605, [], 1),
                                                            (None, rows[0][1], 0), (606, [1.0, 2.0], 0), (606, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = lattice_dedup.near_duplicates(df).collect()

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]):
            return False
        if any(v is None or not math.isfinite(v) for v in a[1] + b[1]) or not any(a[1]) or not any(b[1]):
            return False
        return np.dot(a[1], b[1]) / math.sqrt(np.dot(a[1], a[1]) * np.dot(b[1], b[1])) >= 0.98

    n, links = len(rows), {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(n), 2):
        if linked(rows[i], rows[j]):
            links[i].add(j)
            links[j].add(i)
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        want.append((rows[i][0], len(links[i]), low, rows[i][0] == low and low is not None))
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_hot_cell_is_verified_in_small_groups(spark, monkeypatch):
    """A cell of many chunks: groups are as many as its rows need after each is dealt once per chunk."""
    monkeypatch.setattr(lattice_dedup, "CELL_ROWS", 8)
    monkeypatch.setattr(lattice_dedup, "ROWS_PER_BUCKET", 64)
    asked = []
    count = lattice_dedup.bucket_count
    monkeypatch.setattr(lattice_dedup, "bucket_count", lambda shared: asked.append(
        (shared.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0], count(shared))) or asked[-1][1])
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 1e-3).tolist(), 0) for i in range(120)]
    got = lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 119 and r["component_id"] == 0 for r in got) and len(got) == 120
    (dealt, buckets), = asked
    assert dealt >= 120 * 30 and dealt / buckets <= 64    # 120 rows in 30 chunks


def test_simhash_components(spark, corpus):
    got = simhash_dedup.near_duplicates(docs(spark, corpus)).collect()
    prints = [(i, simhash_dedup.simhash(t or "", 3)) for i, t, _ in corpus]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
            root[find(a)] = find(b)
    low = {}
    for i, (doc_id, _) in enumerate(prints):
        low[find(i)] = min((x for x in (low.get(find(i)), doc_id) if x is not None), default=None)
    want = sorted((str(d), p, str(low[find(i)])) for i, (d, p) in enumerate(prints))
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in got) == want
    kept = [r["doc_id"] for r in simhash_dedup.keep_one(docs(spark, corpus)).collect()]
    assert 0 in kept and not any(200 <= (i or 0) < 240 for i in kept)


def test_one_row_of_every_component_stays(spark):
    """A repeated doc_id loses no text of its own; of copies under null or repeated ids one row stays."""
    rng = random.Random(5)
    a, b, c, d = (words(rng, 40, 1000) for _ in range(4))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (None, c, "s"), (None, c, "t"), (None, a, "s"), (3, d, "s"), (3, d, "t")]
    kept = sorted((str(r["doc_id"]), r["text"], r["size"]) for r in simhash_dedup.keep_one(docs(spark, rows)).collect())
    assert kept == sorted([("1", a, 7), ("2", b, 7), ("None", c, 7), ("3", d, 7)])


def test_block_tables_find_all_close_pairs(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(63) for _ in range(60)]
    for v in values[:40]:
        values += [v ^ 1 << rng.randrange(63), v ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63)]
    values = sorted(set(values))
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    for bits in (1, 2, 3):
        got = sorted(map(tuple, simhash_dedup.near_links(nodes, bits, 6).collect()))
        assert got == [(a, b) for a, b in itertools.combinations(values, 2) if bin(a ^ b).count("1") <= bits]


def test_cells_of_a_small_table_are_not_broadcast(spark):
    """A table below the broadcast threshold has 28 cells a row, which the driver would have to hold."""
    rows = settle(spark.range(3000).select(F.xxhash64("id").alias("fp")).unionByName(spark.range(50).select(F.xxhash64("id").bitwiseXOR(F.lit(9)).alias("fp"))))
    links = simhash_dedup.near_links(rows)
    assert links.count() == 50
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_fingerprints_in_order(spark, corpus, monkeypatch):
    monkeypatch.setattr(simhash_fingerprint, "DOCS_PER_BUCKET", 16)
    rows = [r for r in corpus if r[0] is not None and r[0] != 304]
    got = {r["doc_id"]: r for r in simhash_fingerprint.fingerprints(docs(spark, rows)).collect()}
    ordered = sorted((i, t or "") for i, t, _ in rows)
    assert len(got) == len(ordered)
    import hashlib
    for (i, a), (j, b) in zip(ordered, ordered[1:] + ordered[:1]):
        edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        assert got[i]["n_chars"] == len(a) and got[i]["next_fp"] == got[j]["fp"]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[300]["fp"] == got[302]["fp"] == 0 and got[200]["fp"] == got[0]["fp"]
    alone = simhash_fingerprint.fingerprints(docs(spark, corpus[:1])).first()
    assert alone["fp"] == alone["next_fp"]
    assert simhash_fingerprint.fingerprints(docs(spark, corpus)).count() == len(corpus)


def test_token_counts(spark, corpus):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "漢", "the", "aa", "<s>", "==", "\x00", "    ", "ing"]
    rows = corpus + [(400 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(40))), "s") for i in range(400)]
    rows += [(900, "a" * 3000, "s"), (901, " " * 70, "s"), (902, "=" * 150, "s")]
    got = token_counts.token_counts(docs(spark, rows), path).collect()
    want = [(str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in rows]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == sorted(want)


def test_url_filter(spark):
    urls = ["http://a.net/x", "HTTPS://Ex.Example.NET/en/1?q#f", "http://net", "no scheme", None, "://example.com/de/", "x://b.example.com/de",
            "http://fr.org/fr/x", "http://.net/", "http://xnet/"]
    df = spark.createDataFrame([(i, u, "e") for i, u in enumerate(urls)], "page_id int, url string, host string")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    block = ("net/", "block")
    assert got == {0: block, 1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"),
                   5: ("example.com/de/", "block"), 6: (None, "allow"), 7: ("org/fr/", "allow"), 8: block, 9: (None, "allow")}
    assert all(r["verdict"] == "allow" for r in url_filter.judge(df, []).collect())


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"key{i}" for i in range(3000)]
    listed = set(keys[::7])
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    for bits in (2, 10):    # few bits: many levels
        cascade = url_filter.build_cascade(universe, bits_per_key=bits)
        assert [k for k, there in zip(keys, cascade.has(keys)) if there] == keys[::7]
    shards = url_filter.build_cascade(universe, max_level_bytes=200)
    assert len(shards.shards) > 1 and set(np.array(keys)[shards.has(keys)]) == listed


def test_mixing(spark, corpus):
    sized = spark.createDataFrame([(k, i, s, len((t or "").split())) for k, (i, t, s) in enumerate(corpus)],
                                  "rid bigint, doc_id bigint, source string, size bigint")
    m = mixing.mix(sized, block_words=8)
    taken = [r for r in mixing.taken_words(m).collect()]
    assert len(taken) == len(corpus) and all(0 <= r["taken"] <= 2 * r["size"] for r in taken)
    sources = {r["source_no"]: r for r in m.sources.collect()}
    total = sum(len((t or "").split()) for _, t, _ in corpus)
    assert sum(r["target"] for r in sources.values()) == pytest.approx(1.5 * total)
    for no, s in sources.items():
        assert abs(sum(r["taken"] for r in taken if r["source_no"] == no) - s["target"]) <= 8 + 0.02 * s["target"]
    slots = m.slots.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    again = sorted(map(tuple, mixing.taken_words(m).collect()), key=str)
    assert again == sorted(map(tuple, taken), key=str)


def test_targets_share_the_excess():
    got = mixing.targets([mixing.Source("b", 100), mixing.Source(None, 40), mixing.Source("a", 10)])
    assert [s.name for s in got] == ["a", "b", None]
    assert [s.target for s in got] == pytest.approx([20, 225 - 20 - 80, 80])


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, 4)
        assert sorted(mixing.permuted(np.arange(n), n, keys).tolist()) == list(range(n))


def test_mixed_documents_hold_the_taken_words(spark, corpus):
    rows = [(i, t, s) for i, t, s in corpus if i is not None and i != 304]
    text = {i: (t or "").split() for i, t, _ in rows}
    out = mixing.mixed_documents(docs(spark, rows), block_words=8).collect()
    assert set(out[0].asDict()) == {c.split()[0] for c in DOCS.split(", ")}
    assert abs(sum(len(r["text"].split()) for r in out) - 1.5 * sum(map(len, text.values()))) < 60
    for r in out[:50]:
        rest = iter(text[r["doc_id"]])
        assert all(w in rest for w in r["text"].split()) and r["n_chars"] == len(r["text"])    # in order


def test_packing(spark, corpus):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for ranks in ((), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        got = packing.pack(packing.pieces(docs(spark, corpus), path, *ranks)).collect()
        fill = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == fill.get(r["sequence_id"], 0)
            fill[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
        want = []
        for i, t, _ in corpus:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
            for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
                want.append((str(i), k, start, n, zlib.crc32(np.array(ids[start:start + n], dtype="<u4").tobytes())))
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_counts_before_in_two_levels(spark):
    rng = random.Random(8)
    rows = [(k, b, rng.randrange(1, 9)) for k in (1, 2, None) for b in sorted(rng.sample(range(60), 25))]
    got = common.counts_before(spark.createDataFrame(rows, "key int, block bigint, n bigint"), "key", "block", "n", "before", bits=2)
    want = [(k, b, n, sum(m for j, c, m in rows if j == k and c < b)) for k, b, n in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_plan_is_valid_and_tight():
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randrange(1, 101): rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))}
        runs = packing.plan_bins(counts, 100)
        placed = {}
        for many, lengths in runs:
            assert sum(lengths) <= 100 and sum(3 * n > 100 for n in lengths) <= 2
            for n in lengths:
                placed[n] = placed.get(n, 0) + many
        assert placed == counts


def test_chunk_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.ChunkEncoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                                                        public_tokenizers.PATTERN)
    rng = random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\u00a0", "'s", "1", "!?", "é", "漢", "😀", "<|endoftext|>", "\r\n", "\x1c", "\u2003"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    for c in itertools.chain(range(0x3000), range(0x3000, 0x110000, 251)):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)}!{chr(c)}"
            assert np.frombuffer(encoder._encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(c)
