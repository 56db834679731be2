"""The vocabulary of 8,192 tokens and what depends on it, against the public tokenizers library (trainer, encoder, decoder)."""
import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers, trainers

from seqlake.operators import bpe, bpe_training
from seqlake.plans import QUERIES, tokens
from seqlake.sources import io

FOLDER = "/root/testdata/sf0.001"
FOLD = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def dna(text):
    return "".join(c if c in "ACGT" else "N" for c in text.lower().translate(FOLD))


def library(texts, vocab_size):
    """The library's tokenizer, trained on the N-free segments of texts; N is a piece of its own."""
    t = Tokenizer(models.BPE(unk_token="N"))
    t.pre_tokenizer = pre_tokenizers.Split(Regex("N"), "removed")
    t.train_from_iterator([s for x in texts for s in x.upper().split("N") if s], trainers.BpeTrainer(
        vocab_size=vocab_size, min_frequency=0, special_tokens=bpe.SPECIALS, initial_alphabet=bpe.INITIAL_ALPHABET, show_progress=False))
    t.pre_tokenizer = pre_tokenizers.Split(Regex("N"), "isolated")
    return t


def names(t):
    return [t.id_to_token(i) for i in range(t.get_vocab_size())]


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def trained(rows):
    return library([dna(r["text"]) for r in rows], tokens.VOCAB_SIZE)


@pytest.fixture(scope="module")
def ids(rows, trained):
    return {r["doc_id"]: trained.encode(dna(r["text"])).ids for r in rows}


def test_trained_vocabulary(spark, trained):
    got = QUERIES["bpe_vocab"](spark, FOLDER).orderBy("token_id").collect()
    assert [r.token for r in got] == names(trained) and len(got) > 3000
    merges = QUERIES["bpe_train"](spark, FOLDER).orderBy("rank").collect()
    assert [r.rank for r in merges] == list(range(len(merges))) and len(merges) >= len(got) - 8


def test_encodings(spark, rows, trained, ids):
    md5 = lambda x: hashlib.md5(",".join(map(str, x)).encode()).hexdigest()
    got = {r.seq_id: (r.n_tokens, r.ids_md5) for r in QUERIES["bpe_encode"](spark, FOLDER).collect()}
    assert got == {i: (len(x), md5(x)) for i, x in ids.items()}
    used = {r.token_id: r.n for r in QUERIES["vocab_usage"](spark, FOLDER).collect()}
    assert used == dict(Counter(t for x in ids.values() for t in x))
    by = {r.source: (r.n_seqs, r.n_tokens, r.n_bases) for r in QUERIES["token_stats"](spark, FOLDER).collect()}
    assert by == {g: (sum(1 for r in rows if r["lang"] == g), sum(len(ids[r["doc_id"]]) for r in rows if r["lang"] == g),
                      sum(len(r["text"]) for r in rows if r["lang"] == g)) for g in {r["lang"] for r in rows}}
    checks = QUERIES["input_checks"](spark, FOLDER).first()
    assert (checks.n_rows, checks.n_pad_without_mask, checks.n_missing_bos, checks.n_too_long) == (
        len(ids), 0, len(ids), sum(len(x) > 8192 for x in ids.values()))


def plain_windows(x, context=tokens.CONTEXT):
    step = context - 2
    return [[1, *x[:step], 2]] if len(x) <= context else [[1, *x[i:i + step], 2] for i in range(0, len(x), step)]


def test_windows_and_batches(spark, rows, ids):
    md5 = lambda x: hashlib.md5(",".join(map(str, x)).encode()).hexdigest()
    want = [(i, k, len(w), md5(w)) for i, x in ids.items() for k, w in enumerate(plain_windows(x))]
    got = [(r.seq_id, r.window_no, r.n_tokens, r.ids_md5) for r in QUERIES["windows_bpe"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)
    lang = {r["doc_id"]: r["lang"] for r in rows}
    labels = {r.label: (r.n_windows, r.n_tokens) for r in QUERIES["window_examples"](spark, FOLDER).collect()}
    assert labels == {g: (sum(lang[w[0]] == g for w in want), sum(w[2] for w in want if lang[w[0]] == g)) for g in set(lang.values())}
    ordered = sorted((i, k, w) for i, x in ids.items() for k, w in enumerate(plain_windows(x)))
    padded = []
    for b in range(0, len(ordered), tokens.BATCH):
        part = ordered[b:b + tokens.BATCH]
        m = max(len(w) for _, _, w in part)
        padded += [(i, k, b // tokens.BATCH, j, m, len(w), md5(w + [0] * (m - len(w)))) for j, (i, k, w) in enumerate(part)]
    assert sorted(tuple(r) for r in QUERIES["pad_batches"](spark, FOLDER).collect()) == padded


def test_full_windows_are_encoded_anew(spark, trained, ids):
    md5 = lambda x: hashlib.md5(",".join(map(str, x)).encode()).hexdigest()
    step, want = tokens.CONTEXT - 2, []
    for i, x in ids.items():
        for k, lo in enumerate(range(0, max(len(x), 1), step)):
            text = "".join(trained.id_to_token(t) for t in x[lo:lo + step])
            w = [1, *trained.encode(text).ids, 2]
            want.append((i, k, len(w), md5(w)))
    assert sorted(tuple(r) for r in QUERIES["windows_full"](spark, FOLDER).collect()) == sorted(want)


def test_corpus_to_tokenizer(spark, rows):
    """One id of every strain, its first shard's copies, learned from."""
    seeded = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    labelled = set(pq.read_table(f"{FOLDER}/labels.parquet").column("doc_id").to_pylist())
    strains = {}
    for r in rows:
        strains.setdefault((r["source"], r["doc_id"] // 10), []).append(r)
    texts = []
    for group in strains.values():
        r = min(group, key=lambda r: (seeded(r["doc_id"]), r["doc_id"]))
        s = dna(r["text"])
        if r["doc_id"] in labelled and (r["doc_id"] + 1) % 4 < r["doc_id"] % 4:
            s = s.lower()
        if len(s) > 100_000:
            at = int(seeded(r["doc_id"])[:8], 16) % (len(s) - 100_000 + 1)
            s = s[at:at + 100_000]
        texts.append(s)
    want = names(library(texts, tokens.VOCAB_SIZE))
    got = QUERIES["corpus_to_tokenizer"](spark, FOLDER).orderBy("rank").collect()
    assert len(texts) > 20 and list(dict.fromkeys(r.token for r in got)) == want[8:]


def segments(spark, texts):
    return bpe.segment_counts(spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string"))


def plain_training(texts, tokens, size):
    """One merge at a time over everything, from a given list of tokens."""
    tokens, merges = list(tokens), []
    corpus = [[tokens.index(c) for c in s] for t in texts for s in t.split("N") if s]
    while len(tokens) < size:
        count = Counter(p for x in corpus for p in zip(x, x[1:]))
        if not count:
            break
        pair = min(count, key=lambda p: (-count[p], p))
        name = tokens[pair[0]] + tokens[pair[1]]
        if name not in tokens:
            tokens.append(name)
        new = tokens.index(name)
        merges.append((*pair, new, count[pair]))
        for n, x in enumerate(corpus):
            out, k = [], 0
            while k < len(x):
                hit = tuple(x[k:k + 2]) == pair
                out.append(new if hit else x[k])
                k += 2 if hit else 1
            corpus[n] = out
    return tokens, merges


REPEATS = ["ACAC", "AAAA", "ACA", "CACA", "GG", "T"]


def repetitive(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(REPEATS) if rng.random() < 0.7 else rng.choice("ACGTN") for _ in range(rng.randrange(3, 60))) for _ in range(n)]


@pytest.mark.parametrize("max_pieces, size", [(1, 20), (60, 120), (50_000, 400)])
def test_rounds_equal_the_library_whatever_the_bound(spark, max_pieces, size):
    texts = repetitive(max_pieces)
    m = bpe.train_bpe(segments(spark, texts), vocab_size=size, max_pieces=max_pieces)
    assert m.tokens == names(library(texts, size))


@pytest.mark.parametrize("max_pieces", [30, 50_000])
def test_ids_used_again(spark, max_pieces):
    """Tokens that exist before their merge gain occurrences, also across cuts."""
    known = bpe.SPECIALS + ["A", "C", "G", "N", "T", "AC", "ACA", "CA", "GG", "ACAC", "AA", "TA", "GGT"]
    texts, tokens = repetitive(5, 30), list(known)
    got = bpe_training.learn_merges(segments(spark, texts), tokens, 60, max_pieces=max_pieces)
    want_tokens, want = plain_training(texts, known, 60)
    assert tokens == want_tokens and [(a, b, new, n) for _, a, b, new, _, n in got] == want
    assert len(got) > 60 - len(known)


def test_random_corpora_equal_the_library(spark):
    for seed in (0, 3):
        rng = random.Random(seed)
        texts = ["".join(rng.choice("ACGTRN"[:3 + seed]) for _ in range(rng.randrange(1, 80))) for _ in range(80)]
        m = bpe.train_bpe(segments(spark, texts), vocab_size=300, max_pieces=2000)
        t = library(texts, 300)
        assert m.tokens == names(t)
        encoder = bpe.SegmentEncoder({x: i for i, x in enumerate(m.tokens) if len(x) == 1 and i > 2},
                                     {(a, b): (r, n) for r, a, b, n, _, _ in reversed(m.merges)})
        for x in texts + ["A" * 3000, "ACGT" * 500]:
            for s in x.split("N"):
                if set(s) <= set(m.alphabet):
                    assert encoder.merge(s) == t.encode(s).ids, s


def test_limits_of_training(spark):
    texts = ["ACGTACGTACGT", "ACGTACGG", "TTTTTT"]
    assert max(map(len, bpe.train_bpe(segments(spark, texts), vocab_size=60, max_token_length=3).tokens[8:])) <= 3
    assert all(n >= 3 for *_, n in bpe.train_bpe(segments(spark, texts), vocab_size=60, min_frequency=3).merges)
    assert bpe.train_bpe(segments(spark, []), vocab_size=60).merges == []


def test_piece_counts_stay_bounded(spark):
    rng, seen = random.Random(9), []
    texts = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(30)]
    bpe.train_bpe(segments(spark, texts), vocab_size=40, max_pieces=50, report=lambda *a: seen.append(a))
    assert len(seen) > 2 and all(p <= 50 or k == 1 for _, k, p, _ in seen)


def test_encoder_forgets_long_and_old_segments(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    e = bpe.SegmentEncoder({"A": 3, "C": 4, "N": 5}, {(3, 4): (0, 6)})
    for i in range(40):
        text = "A" * i + "C" + "N" + "AC" * 200
        assert [len(x) // 4 for x in e.encode([text, "", "N"])] == [i + (i == 0) + 1 + 200, 0, 1]
    assert e.held < 2000 + 500 and all(len(s) <= bpe.CACHED_LENGTH for s in e.known)


def test_vocabulary_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    before = io.files_state(spark.read.parquet(path))
    assert io.files_state(spark.read.parquet(path)) == before
    spark.range(5).write.mode("overwrite").parquet(path)
    assert io.files_state(spark.read.parquet(path)) != before


def test_training_keeps_other_columns_out(spark):
    df = spark.createDataFrame([("a", "ACGT", [9]), ("b", None, None)], "seq_id string, sequence string, input_ids array<int>")
    m = bpe.train_bpe(bpe.segment_counts(df), vocab_size=10)
    got = bpe.encode_bpe(df, m)
    assert got.columns == ["seq_id", "sequence", "input_ids"]
    assert {r.seq_id: len(r.input_ids) for r in got.collect()} == {"a": 2, "b": 0}
    assert got.select(F.size("input_ids")).count() == 2


def test_pieces_are_cut_at_rare_pairs(spark):
    state = bpe_training.symbols_of(spark.createDataFrame([("AACG", 2), ("CGAA", 1), ("TT", 5), ("A", 9)], "segment string, n bigint"),
                                    {"A": 3, "C": 4, "G": 5, "T": 6}, "segment", "n")
    got = {bytes(r.piece): r.n for r in bpe_training.pieces(state, [(3, 3), (4, 5)]).collect()}
    assert got == {b"\x03\x00\x03\x00": 3, b"\x04\x00\x05\x00": 3}
