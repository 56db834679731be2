import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlake.functions.dna import mask_unknown, normalise_dna
from seqlake.operators import bpe


def _segs(spark, seqs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, sequence string")
    return bpe.segment_counts(df)


def test_pair_counts_overlapping(spark):
    pc = {r.pair: r.n for r in bpe.pair_counts(_segs(spark, ["AAAA"])).collect()}
    assert pc == {"AA": 3}


def test_segments_split_on_n(spark):
    sc = {r.segment: r.n for r in _segs(spark, ["ACNNACG", "ac"]).collect()}
    assert sc == {"AC": 2, "ACG": 1}


def test_alphabet_keeps_iupac_letters(spark):
    m = bpe.train_bpe(_segs(spark, ["ACGTRYACGT"]), vocab_size=12)
    assert m.tokens[:3] == bpe.SPECIALS
    assert {"R", "Y"} <= set(m.alphabet)
    assert m.alphabet == sorted(m.alphabet)


def test_single_base_and_all_n(spark):
    m = bpe.train_bpe(_segs(spark, ["A", "NNNN"]), vocab_size=50)
    assert m.merges == []
    assert m.tokens == bpe.SPECIALS + ["A", "C", "G", "N", "T"]


def _join(tokens, pair, new):
    out = []
    for t in tokens:
        if out and (out[-1], t) == pair and out[-1] is not None:
            out[-1:] = [new, None]    # the None keeps a new token from being joined again at once
        else:
            out.append(t)
    return [t for t in out if t is not None]


def _slow_training(seqs, vocab_size):
    """One merge at a time over the whole corpus: names of the tokens by id, merges as (left id, right id, new id, count)."""
    names = bpe.SPECIALS + sorted(set("ACGTN") | set("".join(seqs)))
    corpus = [[names.index(c) for c in part] for s in seqs for part in s.split("N") if part]
    merges = []
    while len(names) < vocab_size:
        count = Counter(p for tokens in corpus for p in zip(tokens, tokens[1:]))
        if not count:
            break
        pair = min(count, key=lambda p: (-count[p], p))
        name = names[pair[0]] + names[pair[1]]
        if name not in names:
            names.append(name)
        merges.append((*pair, names.index(name), count[pair]))
        corpus = [_join(tokens, pair, names.index(name)) for tokens in corpus]
    return names, merges


def _slow_ids(text, names, merges):
    tokens = [names.index(c if c in names else "N") for c in text.upper()]
    for left, right, new, _ in merges:
        tokens = _join(tokens, (left, right), new)
    return tokens


@pytest.mark.parametrize("vocab_size", [60, 300])    # 300: beyond the merges kept in one projection
def test_training_and_encoding_match_plain_bpe(spark, vocab_size):
    rng = random.Random(3)
    motifs = ["".join(rng.choice("ACGT") for _ in range(9)) for _ in range(40)]
    seqs = ["".join(rng.choice(motifs) if rng.random() < 0.8 else rng.choice("ACGTN") for _ in range(rng.randint(5, 40)))
            for _ in range(60)]
    names, merges = _slow_training(seqs, vocab_size)
    m = bpe.train_bpe(_segs(spark, seqs), vocab_size=vocab_size)
    assert m.tokens == names
    assert [(x[1], x[2], x[3], x[5]) for x in m.merges] == merges
    probe = seqs[:10] + ["acgtXXacgt", "NNNACGT"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(probe)], "seq_id long, sequence string")
    got = {r.seq_id: r.input_ids for r in bpe.encode_bpe(df, m).collect()}
    for i, s in enumerate(probe):
        assert got[i] == _slow_ids(s, names, merges), s


def test_rounds_of_merges_with_ties(spark):
    seqs = ["ACAC", "GTGT", "ACGT", "TTTT", "AACC", "CAGT"]
    names, merges = _slow_training(seqs, 40)
    m = bpe.train_bpe(_segs(spark, seqs), vocab_size=40)
    assert m.tokens == names and [(x[1], x[2], x[3], x[5]) for x in m.merges] == merges


def test_ids_stay_off_surrogates(spark):
    with pytest.raises(ValueError):
        bpe.train_bpe(_segs(spark, ["ACGT"]), vocab_size=0xD801)


def test_decode_roundtrip_and_specials(spark):
    seqs = ["ACGTACGTTTGACA", "GGGCCCAAATTT"]
    m = bpe.train_bpe(_segs(spark, seqs), vocab_size=16)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, sequence string")
    enc = bpe.encode_bpe(df, m)
    out = enc.select("sequence", bpe.decode_bpe("input_ids", m).alias("d"),
                     bpe.truncate("input_ids", 4).alias("t")).collect()
    for r in out:
        assert r.d == r.sequence
        assert r.t[0] == bpe.BOS_ID and r.t[-1] == bpe.EOS_ID and len(r.t) <= 4


def test_encode_bases_bytes(spark):
    df = spark.createDataFrame([("ACGT",), ("",)], "s string")
    got = [r[0] for r in df.select(bpe.encode_bases(F.col("s"))).collect()]
    assert got == [[65, 67, 71, 84], []]


def test_small_corpora_train_in_few_tasks(spark, monkeypatch):
    """Every round has several passes over the distinct segments, so these are not left in the tasks of a shuffle."""
    rng = random.Random(6)
    segs = _segs(spark, ["".join(rng.choice("ACGTN") for _ in range(60)) for _ in range(200)])
    parts, learn = [], bpe.learn_merges
    monkeypatch.setattr(bpe, "learn_merges", lambda s, *a: parts.append(s.rdd.getNumPartitions()) or learn(s, *a))
    few = bpe.train_bpe(segs, vocab_size=30)
    many = bpe.train_bpe(segs.repartition(40), vocab_size=30)
    assert few == many and max(parts) <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(bpe, "TASK_LETTERS", 100)
    assert bpe.train_bpe(segs.repartition(40), vocab_size=30) == many and parts[-1] == 40


def test_batches_are_encoded_in_turns(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_LETTERS", 50)
    texts = ["ACGT" * (i % 9) + "N" * (i % 3) for i in range(60)] + [None, "", "ACGT" * 100]
    sizes = [b.num_rows for b in bpe.letters_at_a_time(pa.record_batch({"t": texts}), pa.array(texts))]
    assert sum(sizes) == len(texts) and max(sizes) < 40 and len(sizes) > 10
    assert [b.num_rows for b in bpe.letters_at_a_time(pa.record_batch({"t": pa.array([], pa.string())}), pa.array([], pa.string()))] in ([], [0])
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, sequence string")
    m = bpe.train_bpe(bpe.segment_counts(df), vocab_size=20)
    assert {r.seq_id: r.d for r in bpe.encode_bpe(df, m).select("seq_id", bpe.decode_bpe("input_ids", m).alias("d")).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_segments_are_counted_before_they_are_sent(spark, monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED_LETTERS", 20)
    texts = ["acgtNACGT", "NN", "", None, "ACGTNNß"] * 9
    df = spark.createDataFrame([(t,) for t in texts], "sequence string")
    assert {r.segment: r.n for r in bpe.segment_counts(df).collect()} == {"ACGT": 27, "SS": 9}


def test_encoding_masks_texts_in_its_own_task(spark):
    """One Python stage, to which every text is sent once; the masking is that of the column functions."""
    texts = ["ACGTacgtnN", "\uff41\uff43\uff27T", "a\u00dfx\U0001f600g\nT]^-[", "\u2460A", "", None, "ACGT\x00\x7fRYK"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, sequence string").withColumn("more", F.lit("x"))
    for corpus in (["ACGTACGT"], ["ACGT]^-[\\", "\u00dfR\U0001f600"]):
        m = bpe.train_bpe(_segs(spark, corpus), vocab_size=40)
        masked = bpe.TokenText(m.alphabet)
        want = {r.seq_id: r.t or "" for r in df.select("seq_id", mask_unknown(normalise_dna("sequence"), "".join(m.alphabet)).alias("t")).collect()}
        assert {i: masked(t) for i, t in enumerate(texts)} == want
        enc = bpe.encode_bpe(df, m, keep=["seq_id"])
        assert enc.columns == ["seq_id", "input_ids"] and bpe.encode_bpe(df, m).columns == ["seq_id", "sequence", "more", "input_ids"]
        assert {r.seq_id: r.t for r in enc.select("seq_id", bpe.decode_bpe("input_ids", m).alias("t")).collect()} == want
        plan = enc._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "more" not in plan.split("MapInArrow")[0]


def test_distinct_segments_a_task_counts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED_SEGMENTS", 3)
    df = spark.createDataFrame([("ACNAGNATNCCNCGNCTNGG",), ("ACNGGNTT",), ("ACNAC",)], "sequence string").coalesce(1)
    assert {r.segment: r.n for r in bpe.segment_counts(df).collect()} == {"AC": 4, "AG": 1, "AT": 1, "CC": 1, "CG": 1, "CT": 1, "GG": 2, "TT": 1}
