"""Small tables for the tests of the training-data operators."""
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size int, rid int"


def docs(spark, rows):
    """Documents (id, text, source[, lang]) with null columns, and further columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[3] if len(r) > 3 else "en", r[2], None, "x", 7, 7) for r in rows], DOCS)
