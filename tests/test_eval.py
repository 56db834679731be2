from pyspark.sql import functions as F

from seqlake.operators import folds as P
from seqlake.operators import metrics as M
from seqlake.operators import probe as Q
from seqlake.operators.index import row_index


def test_row_index_dense(spark):
    df = spark.range(0, 3000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    got = row_index(df, ["a", "b"], "pos", rows_per_range=300).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(3000))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


def test_folds_partition_and_balance(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 50 else 3) for i in range(53)], "row_id long, y int")
    sk = P.stratified_kfold(df, 10)
    per = sk.groupBy("seed", "row_id").count().agg(F.max("count")).first()[0]
    assert per == 1 and sk.count() == 53 * 3
    sizes = sk.groupBy("seed", "y", "fold").count().groupBy("seed", "y").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1
    kf = P.kfold(df, 10).where("seed = 0").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in kf] == [6, 6, 6] + [5] * 7
    ft = P.fold_table(sk, 10)
    roles = ft.groupBy("seed", "fold", "role").count().where("seed = 0 AND fold = 1").collect()
    assert sum(r["count"] for r in roles) == 53


def test_classification_scores(spark):
    def s(pairs):
        df = spark.createDataFrame([(0, y, p) for y, p in pairs], "g int, y int, p int")
        return M.classification_scores(df, ["g"]).first()
    perfect = s([(0, 0), (1, 1), (2, 2)])
    assert perfect.accuracy == 1 and perfect.macro_f1 == 1 and perfect.mcc == 1
    wrong = s([(0, 1), (1, 0)])
    assert wrong.accuracy == 0 and wrong.macro_f1 == 0 and wrong.mcc == -1
    const = s([(0, 0), (1, 0), (2, 0)])
    assert const.mcc == 0 and abs(const.macro_f1 - (0.5 / 3)) < 1e-12
    only_p = s([(0, 0), (0, 5)])
    assert abs(only_p.macro_f1 - (2 / 3) / 2) < 1e-12


def test_regression_scores_ties_and_constant(spark):
    df = spark.createDataFrame([(0, i, float(y), float(p)) for i, (y, p) in enumerate([(1, 1), (2, 2), (2, 2), (3, 5)])],
                               "g int, row_id long, y double, p double")
    r = M.regression_scores(df, ["g"]).first()
    assert abs(r.spearman - 1.0) < 1e-12
    c = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 1.0, 3.0)], "g int, row_id long, y double, p double")
    rc = M.regression_scores(c, ["g"]).first()
    assert rc.r2 == 0.0 and rc.spearman != rc.spearman  # NaN when constant


def test_layer_selection_leaves_nan_out(spark):
    from seqlake.operators import metrics
    nan = float("nan")
    fs = spark.createDataFrame([(1, 0.5, 0.6), (1, nan, 0.8), (2, nan, nan), (2, nan, nan), (3, 0.4, 0.65)],
                               "layer int, test_spearman double, val_spearman double")
    means = {r["layer"]: (r["test_mean"], r["val_mean"]) for r in metrics.layer_means(fs, "spearman").collect()}
    assert means[2] == (None, None) and abs(means[1][1] - 0.7) < 1e-9 and means[1][0] == 0.5
    best = metrics.select_layer(metrics.layer_means(fs, "spearman")).first()
    assert best["selected_layer"] == 1 and abs(best["mean_over_layers"] - 0.45) < 1e-9


def test_primary_metric_of_the_named_tasks():
    from seqlake.operators import metrics
    assert [metrics.primary_metric(task=t) for t in ("virus/covid", "virus/species_40", "fungi/species_20", "covid")] == [
        "macro_f1", "macro_f1", "macro_f1", "mcc"]


def test_settled_tables_go_when_released(spark, tmp_path):
    import os
    from seqlake.session import release, settle
    df = settle(spark.range(5))
    path = df._settled_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 5
    release(df, df, spark.range(1))
    assert not os.path.exists(path)
