from pyspark.sql import functions as F

from seqlake.functions.dna import mask_unknown, normalise_dna, pretokenise


def _one(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def test_normalise_case_and_nfkc(spark):
    got = _one(spark, normalise_dna, ["acgtn", "ACGTnnACGT", "acgu", "ＡＣGT", "AC GT", ""])
    assert got == ["ACGTN", "ACGTNNACGT", "ACGu", "ACGT", "AC GT", ""]


def test_mask_after_normalise(spark):
    got = _one(spark, lambda c: mask_unknown(normalise_dna(c)), ["acgu", "ACXXGT", "AC GT", "NNN"])
    assert got == ["ACGN", "ACNNGT", "ACNGT", "NNN"]


def test_pretokenise_isolates_n(spark):
    got = _one(spark, pretokenise, ["ACNNGT", "NAN", "ACGT", ""])
    assert got == [["AC", "N", "N", "GT"], ["N", "A", "N"], ["ACGT"], []]
