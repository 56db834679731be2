"""The registered queries of the training-data operators, with DuckDB statements where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import (context_tree, divergence, lattice_dedup, lexical_search, lexicon_codec, line_dedup, mixing, packing,
                         quality, simhash_dedup, simhash_fingerprint, token_counts, url_filter)
from seqlake.llm.common import table
from seqlake.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


@register("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return out.select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


@register("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN, capacity=2048, end_id=0)
    return packing.pack(cut, capacity=2048)


OP6_SQL = f"""
WITH docs AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
stops AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '(\n|[.!?][\x20\x09-\x0D])([^\x1E\x20\x09-\x0D])', '\\1' || chr(30) || '\\2', 'g'),
    '(\n|[.!?][\x20\x09-\x0D])([^\x1E\x20\x09-\x0D])', '\\1' || chr(30) || '\\2', 'g') AS text FROM docs),
marked AS (
  SELECT doc_id, regexp_replace(text, '([\x20\x09-\x0D])([A-Z\xC0-\xD6\xD8-\xDE])', '\\1' || chr(30) || '\\2', 'g') AS text FROM stops),
cut AS (
  SELECT doc_id, unnest(string_split(text, chr(30))) AS unit, unnest(range(len(string_split(text, chr(30))))) AS pos FROM marked),
plain AS (
  SELECT doc_id, pos, unit,
         trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x09-\x0D ]+', ' ', 'g')) AS form
  FROM cut),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY form ORDER BY doc_id, pos) > 1 AS again,
         coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN form = '' THEN 0 ELSE len(string_split(form, ' ')) END AS words, strlen(form) AS size
  FROM plain),
islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, again ORDER BY pos) AS island FROM ranked),
runs AS (
  SELECT *, again AND (sum(words) OVER run >= {line_dedup.MIN_WORDS} OR sum(size) OVER run >= {line_dedup.MIN_BYTES})
            AND 2 * sum(CASE WHEN size >= {line_dedup.CLEAR_BYTES} THEN size ELSE 0 END) OVER run >= sum(size) OVER run AS gone
  FROM islands WINDOW run AS (PARTITION BY doc_id, again, island)),
spans AS (
  SELECT doc_id, island, min(start)::BIGINT AS low, max(start + length(unit))::BIGINT AS high FROM runs WHERE gone GROUP BY doc_id, island),
removed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(low || '-' || high, ',' ORDER BY low) AS removed FROM spans GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(string_agg(unit, '' ORDER BY pos) FILTER (NOT gone), '') AS text FROM runs GROUP BY doc_id)
SELECT doc_id, text, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM texts LEFT JOIN removed USING (doc_id)"""


@register("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return out.select("doc_id", "text", F.size("removed_spans").cast("bigint").alias("n_removed"),
                      F.array_join(spans, ",").alias("removed"))


@register("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mixing.mix(settle(mixing.sizes(docs.withColumn("rid", F.monotonically_increasing_id()), "rid")))
    return (mixing.taken_words(m).join(m.sources, "source_no")
            .select("doc_id", "size", "source_size", "target", "taken"))


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

OP5_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
keyed AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
rules(verdict, rule, rhost, rpath) AS (VALUES """ + ", ".join(
    f"('{v}', '{r}', '{url_filter.split_rule(r)[0]}', '{url_filter.split_rule(r)[1]}')" for v, r in URL_RULES) + """),
fits AS (
  SELECT rid, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC) AS n
  FROM keyed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM keyed LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (rid)"""


@register("op5_url_filter", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("text_hash")


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) USING (vec_id)"""


@register("op2_lattice_near_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


@register("op3_simhash_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = settle(simhash_fingerprint.fingerprints(table(spark, sf_dir, "documents")))
    asked = F.col("doc_id") % 20 == 0
    near = simhash_fingerprint.near_counts(prints.where(asked), prints, radius=3)
    found = prints.where(asked).join(near, "fp").select("*", (F.col("n_near") - 1).alias("n_within_3_bits")).drop("n_near")
    rest = prints.where(~F.coalesce(asked, F.lit(False))).withColumn("n_within_3_bits", F.lit(None).cast("bigint"))
    return found.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"),
        simhash_fingerprint.likeness("fp", "edited_fp").alias("near_edited"),
        simhash_fingerprint.likeness("fp", "next_fp").alias("near_next"), "n_within_3_bits")


@register("op8_context_tree_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
cells AS (
  SELECT lang, source, term, coalesce(c.n, 0::HUGEINT) AS n, k.n AS lang_n
  FROM groups JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY lang, source),
rates AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (s.total + 2 * v) AS p,
         1 + (1000000000 * (lang_n + 2)) // (langs.total + 2 * v) AS q
  FROM cells JOIN sizes s USING (lang, source) JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM rates WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@register("op11_source_divergence_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
n AS (SELECT rid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY ALL),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM items) GROUP BY term), totals),
scores AS (
  SELECT item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM items JOIN w USING (term) JOIN tf USING (term) JOIN n USING (rid), totals
  GROUP BY item_id, rid),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores JOIN n USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


@register("op12_lexical_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


@register("op13_bpe_codec")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
