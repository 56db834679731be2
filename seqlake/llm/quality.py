"""Quality classifier: hierarchical empirical Bayes.

Document evidence is the log odds of a logistic regression over the text's shape (how its words,
characters and lines are made up; each feature is cut into bins), less the global log odds. It is combined with the posterior good rate of the document's path (source and
language) and host (source): each host's good rate is shrunk towards the global rate, each path's
towards its host's, the more so the fewer documents the site has. How strongly is estimated from
the data: the prior weight of a level is the one whose beta distribution has the spread that the
sites' rates show beyond sampling noise (method of moments). Labelled documents count for a site
as labelled, all others by their evidence under the global rate, so a site without labels has a
posterior too.

The document model is fitted by Spark's learner on at most ``max_labelled`` labelled rows; site
posteriors are grouped aggregations over all labels and all documents. The driver gets one row of
quantiles, the model and the two prior weights.

Defined results: a null or empty text has all features zero; null hosts and paths are sites of
their own; repeated labels of a doc_id are averaged (half or more: good), labels of unknown
documents and null labels are ignored; without any label everything has evidence 0 and is kept; repeated
rows get the same result; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import free_name, same, small_batches
from seqlake.llm.text_shape import FEATURES, shape
from seqlake.session import settle

CUTS = 16
MAX_LABELLED = 50_000    # labelled rows that the document model is fitted on


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, host, path, x array<double>) of ``docs`` (doc_id, text, host, path)."""
    small_batches(docs.sparkSession)
    x = F.pandas_udf(lambda t: pd.Series([shape(v) for v in t], dtype=object), "array<double>")
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "host", "path", x("text").alias("x"))


def fit_evidence(labelled: DataFrame, max_labelled: int, n_cuts: int = CUTS) -> PipelineModel | None:
    """The document model over ``labelled`` (x, good): features cut at quantiles and at even steps, then a
    logistic regression over the bins. Its training rows are the first ``max_labelled`` by hash of the text."""
    sample = settle(labelled.orderBy("text_hash", "doc_id").limit(max_labelled)
                    .select(F.col("good").cast("double").alias("label"), *_columns()))
    n, kinds = sample.agg(F.count("*"), F.count_distinct("label")).first()
    if kinds < 2:
        return None
    probs = [i / n_cuts for i in range(1, n_cuts)]
    found = sample.agg(*[F.struct(F.percentile_approx(f, probs, 10_000).alias("cuts"), F.min(f).alias("low"),
                                  F.max(f).alias("high")) for f in FEATURES]).first()
    splits = [sorted({-math.inf, math.inf, *q["cuts"], *np.linspace(q["low"], q["high"], n_cuts + 1)[1:-1].tolist()})
              for q in found]
    binned, coded = ([f"{f}_{kind}" for f in FEATURES] for kind in ("bin", "code"))
    return Pipeline(stages=[
        Bucketizer(splitsArray=splits, inputCols=FEATURES, outputCols=binned),
        OneHotEncoder(inputCols=binned, outputCols=coded, handleInvalid="keep"),
        VectorAssembler(inputCols=coded, outputCol="features"),
        LogisticRegression(maxIter=60, regParam=1e-4, standardization=False)]).fit(sample)


def _columns() -> list[Column]:
    return [F.col("x")[i].alias(f) for i, f in enumerate(FEATURES)]


def with_evidence(rows: DataFrame, model: PipelineModel | None, odds: float) -> DataFrame:
    """``rows`` (with x) with the model's log odds less the global ones; 0 without a model."""
    if model is None:
        return rows.withColumn("evidence", F.lit(0.0)).drop("x")
    kept = [c for c in rows.columns if c != "x"]
    scored = model.transform(rows.select(*kept, *_columns()))
    return scored.select(*kept, (vector_to_array("rawPrediction")[1] - odds).alias("evidence"))


def prior_weight(sites: DataFrame, towards: Column) -> float:
    """The pseudo-count of a level's beta prior from its sites (good, n), each with the rate it is shrunk towards."""
    p = towards
    row = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("sites"),
                    F.sum(F.pow(F.col("good") / F.col("n") - p, 2) * F.col("n")).alias("spread"),
                    F.sum(p * (1 - p)).alias("noise"), F.avg(p * (1 - p)).alias("single")).first()
    if not row["n"] or row["n"] * row["n"] <= row["nn"]:
        return 1.0
    between = (row["spread"] - row["noise"] * (1 - 1 / row["sites"])) / (row["n"] - row["nn"] / row["n"])
    return float(min(1e6, max(1.0, row["single"] / between - 1))) if between > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
             max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(doc_id, text_hash, evidence, host_rate, path_rate, p_good, keep): one row per document row."""
    clean = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    known = settle(features(clean))
    truth = (labels.where("doc_id is not null and quality is not null")
             .groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg((F.avg("quality") >= 0.5).alias("good")))
    marked = known.join(truth, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    rate = marked.agg(F.avg(F.col("good").cast("double"))).first()[0]
    rate = 0.5 if rate is None else min(max(rate, 1e-4), 1 - 1e-4)
    odds = math.log(rate / (1 - rate))
    scored = settle(with_evidence(marked, fit_evidence(marked.where("good is not null"), max_labelled), odds))
    soft = F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + odds))))
    paths = scored.groupBy("host", "path").agg(F.sum(soft).alias("good"), F.count("*").alias("n"))
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    weight = prior_weight(hosts, F.lit(rate))
    hosts = hosts.select("h", ((F.col("good") + weight * rate) / (F.col("n") + weight)).alias("host_rate"))
    paths = settle(paths.join(hosts, same((F.col("host"), F.col("h")))).drop("h"))
    weight = prior_weight(paths, F.col("host_rate"))
    posterior = settle(paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_rate",
                                    ((F.col("good") + weight * F.col("host_rate")) / (F.col("n") + weight)).alias("path_rate")))
    site = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    p_good = 1 / (1 + F.exp(-(F.col("evidence") + F.log(site / (1 - site)))))
    return (scored.join(posterior, same((F.col("host"), F.col("h")), (F.col("path"), F.col("p"))))
            .select("doc_id", "text_hash", "evidence", "host_rate", "path_rate", p_good.alias("p_good"))
            .withColumn("keep", F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    bad_id, bad_hash = free_name(docs.columns, "bad_id"), free_name(docs.columns, "bad_hash")
    bad = (classify(docs, labels, threshold).where(~F.col("keep"))
           .select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct())
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, same((F.col("doc_id").cast("bigint"), F.col(bad_id)), (text_hash, F.col(bad_hash))), "left_anti")
