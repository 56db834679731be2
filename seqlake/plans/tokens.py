"""Tokenisation queries: BPE training / encoding / decoding (B*), windows and batches (W*)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlake.operators import bpe, sample, species
from seqlake.operators import windows as W
from seqlake.plans.corpus import SEGS_CTE
from seqlake.plans.registry import register
from seqlake.session import checkpoint_dir
from seqlake.sources import io, views

VOCAB_SIZE = 8192
CONTEXT = 512
BASE_CONTEXT = 4096
BATCH = 24

# Training and encoding at this size are beyond SQL: the queries that depend on the vocabulary have no
# DuckDB statement, and tests hold them against the public tokenizers library (tests/test_bpe_queries.py).

_TRAINED: dict[tuple[str, str], str] = {}    # (application, state of the input's files) -> folder of its vocabulary


def _model(spark, d) -> bpe.BpeModel:
    """The vocabulary of the input: trained by the first query that needs it, written, and read by the others
    as long as the input's files stay as they are."""
    seqs = views.sequences(spark, d)
    key = spark.sparkContext.applicationId, io.files_state(seqs)
    if key not in _TRAINED:
        model = bpe.train_bpe(bpe.segment_counts(seqs), vocab_size=VOCAB_SIZE)
        path = f"{checkpoint_dir(spark)}/vocabulary-{uuid.uuid4().hex}"
        io.write_vocab(model.vocab_df(spark), model.merges_df(spark), path)
        _TRAINED[key] = path
    return bpe.BpeModel.from_frames(*io.read_vocab(spark, _TRAINED[key]))


def _encoded(spark, d, keep=("seq_id",)):
    """The encoded sequences with the columns ``keep``, and the model."""
    model = _model(spark, d)
    return bpe.encode_bpe(views.sequences(spark, d), model, keep=keep), model


@register("bpe_train")
def bpe_train(spark, d):
    """Merges learned from the DNA view (vocabulary of VOCAB_SIZE)."""
    return _model(spark, d).merges_df(spark)


@register("corpus_to_tokenizer")
def corpus_to_tokenizer(spark, d):
    """C1 -> C3 -> C5 -> B1 -> B3: one id sampled per strain, their shards' sequences cropped, merges learned from these."""
    ids = sample.sample_per_group(views.strains(spark, d), "strain", "seq_id")
    cropped = sample.random_crop(sample.select_sequences(ids, views.shards(spark, d)), "sequence", "seq_id")
    return bpe.train_bpe(bpe.segment_counts(cropped), vocab_size=VOCAB_SIZE).merges_df(spark)


@register("bpe_vocab")
def bpe_vocab(spark, d):
    """The vocabulary table."""
    return _model(spark, d).vocab_df(spark).select("token_id", "token")


@register("bpe_encode")
def bpe_encode(spark, d):
    """Every sequence encoded with the merges trained on the same corpus."""
    enc, _ = _encoded(spark, d)
    return enc.select("seq_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                      F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@register("token_stats")
def token_stats(spark, d):
    """Tokens and bases per token per folder."""
    enc, _ = _encoded(spark, d, ["source", "sequence"])
    return bpe.token_stats(enc, ["source"])


@register("vocab_usage")
def vocab_usage(spark, d):
    """Occurrences of every token id over the encoded corpus."""
    enc, _ = _encoded(spark, d)
    return bpe.vocab_usage(enc)


@register("decode_roundtrip", """
WITH """ + SEGS_CTE.split(",\nseg AS")[0] + """
SELECT seq_id, md5(sequence) AS decoded_md5 FROM dna
""")
def decode_roundtrip(spark, d):
    """B4 + B7: every sequence of the DNA view encoded, and decoded from its ids alone."""
    enc, model = _encoded(spark, d)
    return enc.select("seq_id", F.md5(bpe.decode_bpe("input_ids", model)).alias("decoded_md5"))


@register("windows_bpe")
def windows_bpe(spark, d):
    """W1 (+B5/B6): BPE ids cut into wrapped windows of CONTEXT tokens."""
    enc, _ = _encoded(spark, d)
    w = W.windows(enc.select("seq_id", "input_ids"), CONTEXT)
    return w.select("seq_id", "window_no", "start_token", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@register("window_examples")
def window_examples(spark, d):
    """Windows as labelled examples (label = the folder), counted per label."""
    enc, _ = _encoded(spark, d, ["seq_id", "source"])
    ex = W.window_examples(enc.select(F.col("seq_id").alias("row_id"), F.col("source").alias("label"), "input_ids"),
                           CONTEXT)
    return ex.groupBy("label").agg(F.count(F.lit(1)).alias("n_windows"),
                                   F.sum(F.size("input_ids")).cast("bigint").alias("n_tokens"))


@register("pad_batches")
def pad_batches(spark, d):
    """Windows in (seq_id, window_no) order, batches of BATCH, right-padded with [PAD]."""
    enc, _ = _encoded(spark, d)
    w = W.windows(enc.select("seq_id", "input_ids"), CONTEXT)
    b = W.pad_batch(w, BATCH, ["seq_id", "window_no"])
    return b.select("seq_id", "window_no", "batch_no", "row_in_batch",
                    F.size("input_ids").cast("bigint").alias("padded_len"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"),
                    F.md5(F.array_join("input_ids", ",")).alias("padded_md5"))


@register("windows_bases", f"""
WITH {SEGS_CTE.split(",\nseg AS")[0]},
ids AS (SELECT seq_id, list_transform(string_split(sequence, ''), lambda c: ascii(c)) AS ids FROM dna),
w AS (SELECT seq_id, CASE WHEN len(ids) <= {BASE_CONTEXT} THEN [ids[1:{BASE_CONTEXT}]]
                          ELSE list_transform(range(0, len(ids), {BASE_CONTEXT}), lambda i: ids[i + 1:i + {BASE_CONTEXT}]) END AS ws
      FROM ids),
x AS (SELECT seq_id, ws, unnest(range(len(ws))) AS k FROM w)
SELECT seq_id, CAST(k AS INTEGER) AS window_no, CAST(k * {BASE_CONTEXT} AS INTEGER) AS start_token,
       CAST(len(ws[k + 1]) AS BIGINT) AS n_tokens, md5(array_to_string(ws[k + 1], ',')) AS ids_md5
FROM x
""")
def windows_bases(spark, d):
    """B9 + W1 without specials: one token per base, windows of BASE_CONTEXT."""
    s = views.sequences(spark, d).select("seq_id", bpe.encode_bases(F.col("sequence")).alias("input_ids"))
    w = W.windows(s, BASE_CONTEXT, bos=None, eos=None)
    return w.select("seq_id", "window_no", "start_token", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@register("input_checks")
def input_checks(spark, d):
    """Input rules over unwrapped, unpadded encodings used with a species."""
    enc, _ = _encoded(spark, d)
    c = W.check_inputs(enc, mask=None, uses_species=True)
    return c.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.col("pad_without_mask").cast("long")).alias("n_pad_without_mask"),
                 F.sum(F.col("missing_bos").cast("long")).alias("n_missing_bos"),
                 F.sum(F.col("too_long").cast("long")).alias("n_too_long"))


def _token_rows(spark, d):
    return views.token_vectors(spark, d)


@register("next_token_loss", """
WITH t AS (SELECT CAST(vec_id // 8 AS BIGINT) AS seq_id, CAST(vec_id % 8 AS INTEGER) AS pos, label, embedding FROM embeddings),
p AS (SELECT seq_id, pos, embedding, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM t),
q AS (SELECT seq_id, pos, nxt,
             list_max(embedding) AS m, embedding FROM p WHERE nxt IS NOT NULL AND pos >= 1 AND nxt <> -100),
l AS (SELECT seq_id, ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - m)))) + m
                      - CAST(embedding[nxt + 1] AS DOUBLE) AS nll FROM q)
SELECT seq_id, round(avg(nll), 6) AS loss, count(*) AS n_tokens FROM l GROUP BY seq_id
""")
def next_token_loss(spark, d):
    """W8 + W9: next-token pairs (species token present: first prediction skipped) and the
    masked cross-entropy of the per-position logits, per sequence."""
    t = _token_rows(spark, d)
    seqs = t.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("a")) \
        .select("seq_id", F.transform("a", lambda s: s["label"]).alias("input_ids"))
    pairs = W.next_token_pairs(seqs, has_species=True, keep=["seq_id"])
    j = pairs.join(t.select("seq_id", "pos", F.col("embedding").alias("logits")), ["seq_id", "pos"])
    return W.masked_cross_entropy(j, ["seq_id"]).select("seq_id", F.round("loss", 6).alias("loss"), "n_tokens")


@register("windows_full")
def windows_full(spark, d):
    """Slices of CONTEXT - 2 tokens, decoded, encoded anew and wrapped."""
    enc, model = _encoded(spark, d)
    w = W.windows_full(enc.select("seq_id", "input_ids"), model, CONTEXT - 2)
    return w.select("seq_id", "window_no", F.size("input_ids").cast("bigint").alias("n_tokens"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


BASES_CTE = f"""{SEGS_CTE.split(",\nseg AS")[0]},
ids AS (SELECT seq_id, species, list_transform(string_split(sequence, ''), lambda c: ascii(c)) AS ids FROM dna WHERE sequence <> '')"""
OVERFLOW, STRIDE = 1026, 100


@register("windows_overflow", f"""
WITH {BASES_CTE},
n AS (SELECT *, CASE WHEN len(ids) <= {OVERFLOW - 2} THEN 1
                     ELSE 1 + CAST(ceil((len(ids) - {OVERFLOW - 2}) / {OVERFLOW - 2 - STRIDE}) AS BIGINT) END AS windows FROM ids),
w AS (SELECT seq_id, species, ids, unnest(range(windows)) AS k FROM n),
x AS (SELECT seq_id, species, k, [1] || ids[k * {OVERFLOW - 2 - STRIDE} + 1:k * {OVERFLOW - 2 - STRIDE} + {OVERFLOW - 2}] || [2] AS win FROM w)
SELECT seq_id, CAST(k AS INTEGER) AS window_no, species, CAST(len(win) AS BIGINT) AS n_tokens, md5(array_to_string(win, ',')) AS ids_md5 FROM x""")
def windows_overflow(spark, d):
    """W3 + R11: overlapping windows of base tokens; every window has its sequence's species, attached by key."""
    s = views.sequences(spark, d, empty=False)
    named = species.attach_species(s.select("seq_id", "sequence"), s.select("seq_id", "species"), "seq_id")
    bases = named.select("seq_id", "species", bpe.encode_bases(F.col("sequence")).alias("input_ids"))
    w = W.windows_overflow(bases, OVERFLOW, STRIDE)
    return w.select("seq_id", "window_no", "species", F.size("input_ids").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@register("wrap_pairs", f"""
WITH {BASES_CTE},
p AS (SELECT seq_id, ids[1:20] AS a, ids[greatest(len(ids) - 29, 1):len(ids)] AS b FROM ids)
SELECT seq_id, array_to_string([1] || a || [2] || [1] || b || [2], ',') AS ids,
       array_to_string(list_transform(range(len(a) + 2), lambda i: 0) || list_transform(range(len(b) + 2), lambda i: 1), ',') AS types FROM p""")
def wrap_pairs(spark, d):
    """The first 20 and the last 30 bases of a sequence as a pair, with type ids."""
    s = views.sequences(spark, d, empty=False).select("seq_id", bpe.encode_bases(F.col("sequence")).alias("x"))
    ids, types = bpe.wrap_pair(F.slice("x", 1, 20), F.slice("x", F.greatest(F.size("x") - 29, F.lit(1)), 30))
    return s.select("seq_id", F.array_join(ids, ",").alias("ids"), F.array_join(types, ",").alias("types"))


@register("masked_input_checks", f"""
WITH {BASES_CTE},
r AS (SELECT seq_id, CASE WHEN seq_id % 3 = 0 THEN [1] || ids ELSE ids END AS ids, seq_id % 7 = 0 AS shifted FROM ids)
SELECT seq_id, shifted AS left_padded, false AS pad_without_mask, ids[1] <> 1 AS missing_bos, len(ids) > 8192 AS too_long FROM r""")
def masked_input_checks(spark, d):
    """W7 with a mask: every seventh input is padded on the left, every third begins with BOS."""
    s = views.sequences(spark, d, empty=False).select("seq_id", bpe.encode_bases(F.col("sequence")).alias("x"))
    x = F.when(F.pmod("seq_id", F.lit(3)) == 0, F.concat(F.array(F.lit(1)), "x")).otherwise(F.col("x"))
    s = s.select("seq_id", x.alias("input_ids"))
    real = F.array_repeat(F.lit(1), F.size("input_ids"))
    mask = F.when(F.pmod("seq_id", F.lit(7)) == 0, F.concat(F.array(F.lit(0)), real)).otherwise(F.concat(real, F.array(F.lit(0))))
    c = W.check_inputs(s.withColumn("attention_mask", mask), uses_species=True)
    return c.select("seq_id", "left_padded", "pad_without_mask", "missing_bos", "too_long")
