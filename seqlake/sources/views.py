"""Bindings of the driver's test tables to this library's inputs (see README, "Test tables").

Each view is a pure projection / join of the given parquet tables, so its size grows with them:

* sequences: ``documents`` text folded onto A/C/G/T (other characters N); ``seq_id = doc_id``,
  ``source`` (the shard folder) = ``lang``, ``species`` = ``documents.source``.
* shards: every sequence in shard ``pmod(seq_id, 4)`` of its folder; labelled documents also have
  a lower-cased copy in the next shard, so "first shard wins" has work to do.
* taxonomy: ``customer ⋈ nation ⋈ region`` as Species / Genus / Family / Life ranks, with blank,
  blank-only and padded cells chosen by ``pmod(c_custkey, 7)``.
* species vocabulary: ``customer.c_name`` in ``c_custkey`` order; name queries: one per order,
  written in one of eight forms chosen by ``pmod(o_orderkey, 8)``.
* token vectors: ``embeddings`` rows as tokens of sequence ``vec_id div 8``; layers = four
  16-dimension slices; assemblies = ``vec_id div 5``, none for every 11th row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.dna import text_to_dna
from seqlake.functions.vectors import argmax
from seqlake.operators.index import row_index
from seqlake.operators.taxonomy import RANKS



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, empty: bool = True) -> DataFrame:
    """Without ``empty``, those that are neither null nor empty: folding keeps the number of characters, so the text tells."""
    d = table(spark, sf_dir, "documents")
    d = d if empty else d.where(F.col("text") != "")
    return d.select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("source"),
                    F.col("source").alias("species"), text_to_dna(F.col("text")).alias("sequence"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = sequences(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id")).distinct()

    def path(k):
        return F.concat(F.col("source"), F.lit("/part-"), k.cast("string"), F.lit(".parquet"))
    base = seqs.select("source", path(F.pmod("seq_id", F.lit(4))).alias("file"), "seq_id", "sequence")
    copies = (seqs.join(labelled, "seq_id", "left_semi")
              .select("source", path(F.pmod(F.col("seq_id") + 1, F.lit(4))).alias("file"), "seq_id",
                      F.lower("sequence").alias("sequence")))
    return base.unionByName(copies)


def strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, seq_id, strain): a finer grouping than species, whose number of groups grows with the table
    (each species' sequences of ten consecutive ids)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("source"), F.col("doc_id").alias("seq_id"),
                    F.concat_ws(" ", "source", F.floor(F.col("doc_id") / 10).cast("string")).alias("strain"))


def wanted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id list of C3/C4: every labelled document, looked up in its own folder, except toxic
    ones, looked up under ``en``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels")
    return (lab.join(d, "doc_id", "left")
            .select(F.when(F.col("toxic") == 1, F.lit("en")).otherwise(F.coalesce("lang", F.lit("en"))).alias("source"),
                    F.col("doc_id").alias("seq_id")))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    k = F.pmod(F.col("c_custkey"), F.lit(7))
    cols = {
        "Species": F.when(k == 3, F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).otherwise(F.col("c_name")),
        "Genus": F.when(k == 0, F.lit("")).otherwise(F.col("c_mktsegment")),
        "Family": F.when(k == 1, F.lit("  ")).otherwise(F.coalesce(F.col("n_name"), F.lit(""))),
        "Life": F.coalesce(F.col("r_name"), F.lit("")),
    }
    return j.select(F.col("c_custkey").alias("tax_id"),
                    *[cols.get(rk, F.lit("")).alias(rk) for rk in RANKS])


def species_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (row_index(c, ["c_custkey"], "species_id")
            .select(F.col("species_id").cast("int"), F.col("c_name").alias("name")))


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    k = F.pmod(F.col("o_orderkey"), F.lit(8))
    nm = F.col("c_name")
    name = (F.when(k == 0, nm)
            .when(k == 1, F.upper(nm))
            .when(k == 2, F.concat(F.lit("["), nm, F.lit("]")))
            .when(k == 3, F.concat(F.lit("d__Bacteria;s__"), nm))
            .when(k == 4, F.concat(F.lit("k__Bacteria|s__"), F.lower(nm)))
            .when(k == 5, F.concat(F.lit("s__"), nm, F.lit(";s__x")))
            .when(k == 6, F.lit(None).cast("string"))
            .otherwise(F.concat(nm, F.lit(" x"))))
    return j.select(F.col("o_orderkey").alias("row_id"), name.alias("name"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") / 8).cast("bigint").alias("seq_id"),
                    F.pmod("vec_id", F.lit(8)).cast("int").alias("pos"),
                    "vec_id", "label", "embedding")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, p) classification pairs: label vs argmax of the vector, with a fold key."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.pmod("vec_id", F.lit(3)).cast("int").alias("fold"),
                    F.col("label").cast("int").alias("y"),
                    argmax(F.col("embedding")).alias("p"))

