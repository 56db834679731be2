"""Corpus queries: DNA text functions (D*), sampling and selection (C*), segment and pair counts."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.functions.dna import count_char, mask_unknown, normalise_dna, pretokenise
from seqlake.operators import bpe, sample
from seqlake.plans.registry import DNA_CTE, H, HINT, register
from seqlake.sources import views

SEGS_CTE = DNA_CTE + """,
seg AS (SELECT segment, count(*) AS n
        FROM (SELECT unnest(string_split(upper(sequence), 'N')) AS segment FROM dna)
        WHERE segment <> '' GROUP BY segment)"""


@register("segment_pair_counts", f"""
WITH {SEGS_CTE},
p AS (SELECT segment, n, unnest(range(1, length(segment))) AS i FROM seg)
SELECT substr(segment, i, 2) AS pair, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1
""")
def segment_pair_counts(spark, d):
    """D3 + B1 + B2: weighted adjacent-pair counts over the distinct N-free segments."""
    return bpe.pair_counts(bpe.segment_counts(views.sequences(spark, d)))


@register("segment_counts", f"""
WITH {SEGS_CTE}
SELECT segment, CAST(n AS BIGINT) AS n FROM seg
""")
def segment_counts(spark, d):
    return bpe.segment_counts(views.sequences(spark, d))


@register("sample_per_group", f"""
WITH {DNA_CTE}
SELECT species, seq_id FROM (
  SELECT species, seq_id, row_number() OVER (PARTITION BY species ORDER BY {H('seq_id')}, seq_id) AS rn FROM dna)
WHERE rn <= 1
""")
def sample_per_group(spark, d):
    s = views.sequences(spark, d).select("species", "seq_id")
    return sample.sample_per_group(s, "species", "seq_id", n=1, seed=42)


@register("seeded_shuffle", f"""
SELECT doc_id AS seq_id, CAST(row_number() OVER (ORDER BY {H('doc_id')}, doc_id) - 1 AS BIGINT) AS pos
FROM documents
""")
def seeded_shuffle(spark, d):
    s = views.sequences(spark, d).select("seq_id")
    return sample.seeded_shuffle(s, "seq_id", seed=42, cheap=True)


@register("corpus_stats", f"""
WITH {DNA_CTE}
SELECT source, count(*) AS n_seqs, count(DISTINCT seq_id) AS n_ids,
       CAST(sum(length(sequence)) AS BIGINT) AS total_bp
FROM dna GROUP BY source
""")
def corpus_stats(spark, d):
    return sample.corpus_stats(views.sequences(spark, d), ["source"])


@register("length_median", f"""
WITH {DNA_CTE}
SELECT source, CAST(trunc(quantile_cont(length(sequence), 0.5)) AS BIGINT) AS median_len
FROM dna GROUP BY source
""")
def length_median(spark, d):
    return sample.length_median(views.sequences(spark, d), ["source"])


SPLIT_SQL = f"""CASE WHEN {HINT('doc_id', 7)} % 10 < 8 THEN 'train'
                WHEN {HINT('doc_id', 7)} % 10 = 8 THEN 'dev' ELSE 'test' END"""


def _task_splits(spark, d):
    from seqlake.functions.hashing import hash_int
    h = F.pmod(hash_int("doc_id", 7), F.lit(10))
    return views.table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("label"),
        F.when(h < 8, "train").when(h == 8, "dev").otherwise("test").alias("split"))


@register("class_count", f"""
WITH s AS (SELECT doc_id, lang AS label, {SPLIT_SQL} AS split FROM documents)
SELECT split, count(DISTINCT label) AS n_classes FROM s GROUP BY split
UNION ALL SELECT 'all' AS split, count(DISTINCT label) AS n_classes FROM s
""")
def class_count(spark, d):
    s = _task_splits(spark, d)
    per = s.groupBy("split").agg(F.countDistinct("label").alias("n_classes"))
    return per.unionByName(sample.class_count(s, "label").select(F.lit("all").alias("split"), "n_classes"))


SHARDS_CTE = DNA_CTE + """,
shards AS (
  SELECT source, source || '/part-' || CAST(seq_id % 4 AS VARCHAR) || '.parquet' AS file, seq_id, sequence FROM dna
  UNION ALL
  SELECT source, source || '/part-' || CAST((seq_id + 1) % 4 AS VARCHAR) || '.parquet' AS file, seq_id, lower(sequence)
  FROM dna WHERE seq_id IN (SELECT doc_id FROM labels)),
wanted AS (
  SELECT DISTINCT CASE WHEN l.toxic = 1 THEN 'en' ELSE coalesce(d.lang, 'en') END AS source, l.doc_id AS seq_id
  FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id)"""


@register("select_sequences", f"""
WITH {SHARDS_CTE},
hits AS (SELECT s.* FROM shards s JOIN wanted w ON s.source = w.source AND s.seq_id = w.seq_id),
first AS (SELECT source, seq_id, min(file) AS file FROM hits GROUP BY source, seq_id)
SELECT h.source, h.seq_id, h.file, CAST(length(h.sequence) AS BIGINT) AS seq_len, md5(h.sequence) AS seq_md5
FROM hits h JOIN first f ON h.source = f.source AND h.seq_id = f.seq_id AND h.file = f.file
""")
def select_sequences(spark, d):
    out = sample.select_sequences(views.wanted_ids(spark, d), views.shards(spark, d))
    return out.select("source", "seq_id", "file", F.length("sequence").cast("bigint").alias("seq_len"),
                      F.md5("sequence").alias("seq_md5"))


@register("missing_ids", f"""
WITH {SHARDS_CTE}
SELECT w.source, w.seq_id FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM shards s WHERE s.source = w.source AND s.seq_id = w.seq_id)
""")
def missing_ids(spark, d):
    return sample.missing_ids(views.wanted_ids(spark, d), views.shards(spark, d))


CROP = 100_000


@register("random_crop", f"""
WITH {DNA_CTE},
c AS (SELECT seq_id, sequence,
             CASE WHEN length(sequence) > {CROP} THEN {HINT('seq_id')} % (length(sequence) - {CROP} + 1) ELSE 0 END AS crop_start
      FROM dna),
k AS (SELECT seq_id, crop_start,
             CASE WHEN length(sequence) > {CROP} THEN substr(sequence, crop_start + 1, {CROP}) ELSE sequence END AS crop
      FROM c)
SELECT seq_id, CAST(crop_start AS BIGINT) AS crop_start, CAST(length(crop) AS BIGINT) AS crop_len, md5(crop) AS crop_md5
FROM k
""")
def random_crop(spark, d):
    s = sample.random_crop(views.sequences(spark, d), "sequence", "seq_id", max_len=CROP, seed=42,
                           start_col="crop_start")
    return s.select("seq_id", F.col("crop_start").cast("bigint"), F.length("sequence").cast("bigint").alias("crop_len"),
                    F.md5("sequence").alias("crop_md5"))


# NFKC is the identity on the driver's documents (checked at sf0.01), so the oracle only has to
# do the case fix; the Unicode path is covered by unit tests.
@register("normalise_dna", """
SELECT doc_id, md5(translate(text, 'acgtn', 'ACGTN')) AS norm_md5,
       CAST(length(translate(text, 'acgtn', 'ACGTN')) AS BIGINT) AS norm_len
FROM documents
""")
def normalise(spark, d):
    t = views.table(spark, d, "documents")
    n = normalise_dna(F.col("text"))
    return t.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("bigint").alias("norm_len"))


@register("mask_pretokenise", """
WITH m AS (SELECT doc_id, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS masked FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(masked, 'N|[^N]+')) AS BIGINT) AS n_pieces,
       CAST(length(masked) - length(replace(masked, 'N', '')) AS BIGINT) AS n_n, md5(masked) AS masked_md5
FROM m
""")
def mask_pretokenise(spark, d):
    t = views.table(spark, d, "documents")
    m = t.select("doc_id", mask_unknown(normalise_dna(F.col("text"))).alias("masked"))
    return m.select("doc_id", F.size(pretokenise("masked")).cast("bigint").alias("n_pieces"),
                    count_char("masked", "N").alias("n_n"), F.md5("masked").alias("masked_md5"))


def _comp_sql():
    parts = ", ".join(f"CAST(sum(length(t) - length(replace(t, '{b}', ''))) AS BIGINT) AS n_{b.lower()}" for b in "ACGTN")
    return f"""
WITH x AS (SELECT lang AS source, translate(text, 'acgtn', 'ACGTN') AS t FROM documents),
y AS (SELECT source, {parts}, CAST(sum(length(t)) AS BIGINT) AS n_all FROM x GROUP BY source)
SELECT source, n_a, n_c, n_g, n_t, n_n, n_all - n_a - n_c - n_g - n_t - n_n AS n_other FROM y
"""


@register("base_composition", _comp_sql())
def base_composition(spark, d):
    t = views.table(spark, d, "documents").select(F.col("lang").alias("source"), normalise_dna(F.col("text")).alias("t"))
    g = t.groupBy("source").agg(*[F.sum(count_char("t", b)).cast("bigint").alias(f"n_{b.lower()}") for b in "ACGTN"],
                                F.sum(F.length("t")).cast("bigint").alias("n_all"))
    return g.select("source", "n_a", "n_c", "n_g", "n_t", "n_n",
                    (F.col("n_all") - F.col("n_a") - F.col("n_c") - F.col("n_g") - F.col("n_t") - F.col("n_n")).alias("n_other"))
