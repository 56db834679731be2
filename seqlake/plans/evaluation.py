"""Evaluation queries: labels and folds (P*), standardisation, early stopping and window
averaging (Q*), metrics and layer selection (M*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.functions.vectors import argmax, softmax
from seqlake.operators import folds as P
from seqlake.operators import metrics as M
from seqlake.operators import probe as Q
from seqlake.operators import vectors as V
from seqlake.operators import windows as W
from seqlake.plans.registry import r6, register
from seqlake.session import settle
from seqlake.sources import views

K = 10
SEEDS_SQL = "(VALUES (0), (1), (2)) s(seed)"
HSEED = "md5(concat('0', '|', CAST(seed AS VARCHAR) || '|' || CAST({id} AS VARCHAR)))"


def _docs(spark, d):
    t = views.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"))
    return P.factorise(t, "label", "y")


LABELS_CTE = """lab AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS y
                 FROM (SELECT DISTINCT coalesce(CAST(lang AS VARCHAR), 'nan') AS label FROM documents)),
docs AS (SELECT d.doc_id AS row_id, l.label, l.y FROM documents d JOIN lab l ON coalesce(CAST(d.lang AS VARCHAR), 'nan') = l.label)"""


@register("factorise_labels", f"WITH {LABELS_CTE}\nSELECT label, y FROM lab")
def factorise_labels(spark, d):
    """Sorted string labels coded 0..k-1."""
    return _docs(spark, d).select("label", "y").distinct()


KFOLD_CTE = LABELS_CTE + f""",
ks AS (SELECT row_id, seed, row_number() OVER (PARTITION BY seed ORDER BY {HSEED.format(id='row_id')}, row_id) - 1 AS pos,
              count(*) OVER (PARTITION BY seed) AS n FROM docs, {SEEDS_SQL}),
kf AS (SELECT row_id, seed, CAST(1 + CASE WHEN pos < (n % {K}) * (n // {K} + 1) THEN pos // (n // {K} + 1)
                                    ELSE (n % {K}) + (pos - (n % {K}) * (n // {K} + 1)) // greatest(n // {K}, 1) END AS INTEGER) AS fold
       FROM ks)"""


@register("kfold", f"WITH {KFOLD_CTE}\nSELECT row_id, CAST(seed AS INTEGER) AS seed, fold FROM kf")
def kfold(spark, d):
    """Shuffled 10-fold split per seed (first n mod k folds one row larger)."""
    return P.kfold(_docs(spark, d), K).select("row_id", F.col("seed").cast("int"), "fold")


STRAT_CTE = LABELS_CTE + f""",
ss AS (SELECT row_id, seed, y, row_number() OVER (PARTITION BY seed ORDER BY y, {HSEED.format(id='row_id')}, row_id) - 1 AS pos
       FROM docs, {SEEDS_SQL}),
sk AS (SELECT row_id, seed, y, CAST(pos % {K} + 1 AS INTEGER) AS fold FROM ss)"""


@register("stratified_kfold", f"WITH {STRAT_CTE}\nSELECT row_id, CAST(seed AS INTEGER) AS seed, fold FROM sk")
def stratified_kfold(spark, d):
    """Class-balanced shuffled folds per seed."""
    return P.stratified_kfold(_docs(spark, d), K).select("row_id", F.col("seed").cast("int"), "fold")


@register("fold_table", f"""WITH {STRAT_CTE},
lng AS (SELECT sk.row_id, sk.seed, sk.y, sk.fold AS test_fold, f.fold FROM sk, (SELECT unnest(range(1, {K} + 1)) AS fold) f),
tst AS (SELECT row_id, seed, fold, 'test' AS role FROM lng WHERE fold = test_fold),
tr AS (SELECT row_id, seed, fold, y, md5(concat('1', '|', concat_ws('|', CAST(seed AS VARCHAR), CAST(fold AS VARCHAR), CAST(row_id AS VARCHAR)))) AS h
       FROM lng WHERE fold <> test_fold),
c AS (SELECT seed, fold, y, count(*) AS n_c FROM tr GROUP BY ALL),
c2 AS (SELECT *, sum(n_c) OVER g AS n, ceil(sum(n_c) OVER g / 9.0) AS n_val, min(n_c) OVER g >= 2 AS strat
       FROM c WINDOW g AS (PARTITION BY seed, fold)),
c3 AS (SELECT *, n_val * n_c / n AS ex, floor(n_val * n_c / n) AS fl FROM c2),
c4 AS (SELECT *, n_val - sum(fl) OVER (PARTITION BY seed, fold) AS lft,
              row_number() OVER (PARTITION BY seed, fold ORDER BY ex - fl DESC, y) AS r FROM c3),
q AS (SELECT seed, fold, y, strat, n, fl + CASE WHEN r <= lft THEN 1 ELSE 0 END AS quota FROM c4),
st AS (SELECT tr.row_id, tr.seed, tr.fold,
              CASE WHEN row_number() OVER (PARTITION BY tr.seed, tr.fold, tr.y ORDER BY tr.h, tr.row_id) - 1 < q.quota
                   THEN 'val' ELSE 'train' END AS role
       FROM tr JOIN q ON tr.seed = q.seed AND tr.fold = q.fold AND tr.y = q.y WHERE q.strat),
pl AS (SELECT tr.row_id, tr.seed, tr.fold,
              CASE WHEN row_number() OVER (PARTITION BY tr.seed, tr.fold ORDER BY tr.h, tr.row_id) - 1 < ceil(count(*) OVER (PARTITION BY tr.seed, tr.fold) / 9.0)
                   THEN 'val' ELSE 'train' END AS role
       FROM tr WHERE (SELECT NOT bool_and(strat) FROM q WHERE q.seed = tr.seed AND q.fold = tr.fold))
SELECT row_id, CAST(seed AS INTEGER) AS seed, CAST(fold AS INTEGER) AS fold, role FROM (SELECT * FROM tst UNION ALL SELECT * FROM st UNION ALL SELECT * FROM pl)""")
def fold_table(spark, d):
    """P5 + P6: (row, seed, fold, role) with an 8:1:1 train / val / test split per fold."""
    ft = P.fold_table(P.stratified_kfold(_docs(spark, d), K), K)
    return ft.select("row_id", F.col("seed").cast("int"), F.col("fold").cast("int"), "role")


SPLIT = "CASE WHEN ('0x' || substr(md5(concat('7', '|', CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT % 10 < 8 THEN 'train' " \
        "WHEN ('0x' || substr(md5(concat('7', '|', CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT % 10 = 8 THEN 'dev' ELSE 'test' END"


@register("given_split", f"""WITH {LABELS_CTE},
sp AS (SELECT d.row_id, d.y, {SPLIT.replace('doc_id', 'd.row_id')} AS split FROM docs d),
nc AS (SELECT max(y) + 1 AS n_classes FROM sp WHERE split = 'train')
SELECT CAST(seed AS INTEGER) AS seed, CASE WHEN split = 'dev' THEN 'val' ELSE split END AS role, count(*) AS n,
       CAST((SELECT n_classes FROM nc) AS INTEGER) AS n_classes
FROM sp, {SEEDS_SQL} GROUP BY 1, 2""")
def given_split(spark, d):
    """The table's own split, one run per seed."""
    from seqlake.plans.corpus import _task_splits
    sp = _task_splits(spark, d).select(F.col("doc_id").alias("row_id"), "split")
    sp = sp.join(_docs(spark, d).select("row_id", "y"), "row_id")
    g = P.given_split(sp)
    return g.groupBy(F.col("seed").cast("int").alias("seed"), "role").agg(
        F.count(F.lit(1)).alias("n"), F.first("n_classes").cast("int").alias("n_classes"))


@register("standardise", f"""
WITH e AS (SELECT vec_id AS row_id, embedding FROM embeddings),
ks AS (SELECT row_id, seed, row_number() OVER (PARTITION BY seed ORDER BY {HSEED.format(id='row_id')}, row_id) - 1 AS pos,
              count(*) OVER (PARTITION BY seed) AS n FROM e, {SEEDS_SQL}),
kf AS (SELECT row_id, seed, 1 + CASE WHEN pos < (n % {K}) * (n // {K} + 1) THEN pos // (n // {K} + 1)
                                ELSE (n % {K}) + (pos - (n % {K}) * (n // {K} + 1)) // greatest(n // {K}, 1) END AS test_fold FROM ks),
lng AS (SELECT kf.row_id, kf.seed, kf.test_fold, f.fold FROM kf, (SELECT unnest(range(1, {K} + 1)) AS fold) f),
tr AS (SELECT row_id, seed, fold, md5(concat('1', '|', concat_ws('|', CAST(seed AS VARCHAR), CAST(fold AS VARCHAR), CAST(row_id AS VARCHAR)))) AS h
       FROM lng WHERE fold <> test_fold),
roles AS (SELECT row_id, seed, fold, CASE WHEN row_number() OVER (PARTITION BY seed, fold ORDER BY h, row_id) - 1
                                             < ceil(count(*) OVER (PARTITION BY seed, fold) / 9.0) THEN 'val' ELSE 'train' END AS role FROM tr
          UNION ALL SELECT row_id, seed, fold, 'test' AS role FROM lng WHERE fold = test_fold),
x AS (SELECT r.seed, r.fold, r.role, i AS dim, CAST(e.embedding[i + 1] AS DOUBLE) AS v
      FROM roles r JOIN e ON r.row_id = e.row_id, (SELECT unnest(range(64)) AS i) ii),
st AS (SELECT seed, fold, dim, avg(v) AS mu, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sd
       FROM x WHERE role = 'train' GROUP BY ALL)
SELECT CAST(x.seed AS INTEGER) AS seed, CAST(x.fold AS INTEGER) AS fold, CAST(x.dim AS INTEGER) AS dim,
       round(avg((x.v - st.mu) / st.sd), 6) + 0.0 AS test_mean
FROM x JOIN st ON x.seed = st.seed AND x.fold = st.fold AND x.dim = st.dim WHERE x.role = 'test' GROUP BY ALL""")
def standardise(spark, d):
    """Q1 (+P4, P6): per fold, train-fitted standardisation; mean of the standardised test rows."""
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    roles = P.fold_table(P.kfold(e.select("row_id"), K), K, label=None)
    lf = V.long_form(e, ["row_id"])
    z = Q.standardise(roles.join(lf, "row_id"), ["seed", "fold"])
    return z.where(F.col("role") == "test").groupBy(F.col("seed").cast("int").alias("seed"), F.col("fold").cast("int").alias("fold"),
                                                  F.col("dim").cast("int").alias("dim")).agg(r6(F.avg("v")).alias("test_mean"))


@register("early_stopping", """
WITH h AS (SELECT user_id AS run, event_id AS epoch, value AS loss FROM events),
a AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM h),
b AS (SELECT *, (pb IS NULL OR loss < pb) AS imp FROM a),
c AS (SELECT *, sum(CASE WHEN imp THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b),
e AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS wt FROM c),
s AS (SELECT run, min(epoch) AS stop FROM e WHERE wt >= 5 GROUP BY run),
r AS (SELECT e.* FROM e LEFT JOIN s ON e.run = s.run WHERE s.stop IS NULL OR e.epoch <= s.stop)
SELECT run, max(epoch) AS stop_epoch, count(*) AS n_epochs, max(CASE WHEN imp THEN epoch END) AS best_epoch,
       arg_max(loss, CASE WHEN imp THEN epoch END) AS best_loss
FROM r GROUP BY run""")
def early_stopping(spark, d):
    """Q3: events as per-user loss histories, patience 5."""
    h = views.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
                                               F.col("value").alias("loss"))
    return Q.early_stop(h, ["run"], patience=5)


@register("window_average", """
WITH w AS (SELECT vec_id // 3 AS seq_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
p AS (SELECT seq_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM w),
q AS (SELECT seq_id, list_transform(e, lambda x: x / list_sum(e)) AS pr FROM p),
x AS (SELECT seq_id, unnest(range(len(pr))) AS k, unnest(pr) AS prob FROM q),
a AS (SELECT seq_id, k, avg(prob) AS prob FROM x GROUP BY ALL),
m AS (SELECT seq_id, arg_max(k, prob) AS pred, max(prob) AS pmax FROM (SELECT seq_id, k, prob FROM a) GROUP BY seq_id)
SELECT seq_id, CAST(pred AS INTEGER) AS pred, round(pmax, 6) + 0.0 AS pmax FROM m""")
def window_average(spark, d):
    """Q4-Q6: window logits -> softmax -> probabilities averaged per sequence -> argmax."""
    e = views.table(spark, d, "embeddings").select((F.col("vec_id") / 3).cast("bigint").alias("seq_id"),
                                                   F.col("embedding").alias("logits"))
    out = Q.average_windows(e)
    return out.select("seq_id", "pred", r6(F.array_max("probs")).alias("pmax"))


def _cls_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    co = ", ".join(f"coalesce(t.{c}, pk.{c}) AS {c}" for c in keys)
    return f"""{src},
cm AS (SELECT {k}, y, p, count(*) AS c FROM pr GROUP BY ALL),
t AS (SELECT {k}, y AS kk, sum(c) AS t_k FROM cm GROUP BY ALL),
pk AS (SELECT {k}, p AS kk, sum(c) AS p_k FROM cm GROUP BY ALL),
tp AS (SELECT {k}, y AS kk, sum(c) AS tp FROM cm WHERE y = p GROUP BY ALL),
per AS (SELECT {co}, coalesce(t.kk, pk.kk) AS kk, coalesce(t.t_k, 0) AS t_k, coalesce(pk.p_k, 0) AS p_k
        FROM t FULL JOIN pk ON {on('t', 'pk')} AND t.kk = pk.kk),
per2 AS (SELECT per.*, coalesce(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON {on('per', 'tp')} AND per.kk = tp.kk),
agg AS (SELECT {k}, CAST(sum(tp) AS DOUBLE) AS correct, CAST(sum(t_k) AS DOUBLE) AS n,
               avg(CASE WHEN t_k + p_k > 0 THEN 2.0 * tp / (t_k + p_k) ELSE 0 END) AS macro_f1,
               sum(CAST(p_k AS DOUBLE) * t_k) AS pt, sum(CAST(p_k AS DOUBLE) * p_k) AS pp, sum(CAST(t_k AS DOUBLE) * t_k) AS tt
        FROM per2 GROUP BY ALL),
scores AS (SELECT {k}, correct / n AS accuracy, macro_f1,
                  CASE WHEN sqrt((n * n - pp) * (n * n - tt)) <> 0 THEN (correct * n - pt) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0 END AS mcc
           FROM agg)"""


PRED_SRC = """pr AS (SELECT CAST(vec_id % 3 AS INTEGER) AS fold, label AS y,
                   CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS p FROM embeddings)"""


@register("classification_metrics", f"""WITH {_cls_sql(PRED_SRC, ['fold'])}
SELECT fold, round(accuracy, 6) + 0.0 AS accuracy, round(macro_f1, 6) + 0.0 AS macro_f1, round(mcc, 6) + 0.0 AS mcc FROM scores""")
def classification_metrics(spark, d):
    """M1-M3 per fold: label vs argmax of the vector."""
    s = M.classification_scores(views.predictions(spark, d), ["fold"])
    return s.select("fold", *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "mcc")])


@register("regression_metrics", """
WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS y, l_quantity * 1000.0 * (1 - l_discount) AS p FROM lineitem),
k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry,
               rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0 AS rp FROM r),
a AS (SELECT grp, covar_pop(ry, rp) AS cv, var_pop(ry) AS vy, var_pop(rp) AS vp, sum((y - p) * (y - p)) AS sse,
             var_pop(y) * count(*) AS sst, count(*) AS n FROM k GROUP BY grp)
SELECT grp, round(CASE WHEN vy > 0 AND vp > 0 THEN cv / sqrt(vy * vp) ELSE 'NaN'::DOUBLE END, 6) + 0.0 AS spearman,
       round(CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END, 6) + 0.0 AS r2,
       round(sqrt(sse / n), 6) + 0.0 AS rmse
FROM a""")
def regression_metrics(spark, d):
    """M4-M6 per return flag: extended price vs a quantity-based prediction."""
    li = views.table(spark, d, "lineitem")
    r = li.select(F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
                  F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(1000.0) * (1 - F.col("l_discount"))).alias("p"))
    s = M.regression_scores(r, ["grp"])
    return s.select("grp", *[r6(c).alias(c) for c in ("spearman", "r2", "rmse")])


LAYER_SRC = """pr AS (SELECT CAST(l AS INTEGER) AS layer, CAST(vec_id % 3 AS INTEGER) AS seed, CAST((vec_id // 3) % 10 + 1 AS INTEGER) AS fold,
                    CASE WHEN (vec_id // 30) % 2 = 0 THEN 'test' ELSE 'val' END AS split, label AS y,
                    CAST(list_position(embedding[l * 16 + 1:l * 16 + 16], list_max(embedding[l * 16 + 1:l * 16 + 16])) - 1 AS INTEGER) AS p
             FROM embeddings, (SELECT unnest(range(4)) AS l) ll)"""


def _layer_preds(spark, d):
    e = views.table(spark, d, "embeddings")
    return e.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)),
                                             lambda l: argmax(F.slice("embedding", l * 16 + 1, 16)))).alias("layer", "p"),
                    F.pmod("vec_id", F.lit(3)).cast("int").alias("seed"),
                    (F.pmod((F.col("vec_id") / 3).cast("bigint"), F.lit(10)) + 1).cast("int").alias("fold"),
                    F.when(F.pmod((F.col("vec_id") / 30).cast("bigint"), F.lit(2)) == 0, "test").otherwise("val").alias("split"),
                    F.col("label").alias("y")).withColumn("layer", F.col("layer").cast("int"))


def _layer_losses(spark, d):
    """Mean cross-entropy of the val rows: a layer's 16 numbers as logits."""
    e = views.table(spark, d, "embeddings")
    rows = e.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda l: F.slice("embedding", l * 16 + 1, 16))).alias("layer", "logits"),
                    F.pmod("vec_id", F.lit(3)).cast("int").alias("seed"),
                    (F.pmod((F.col("vec_id") / 3).cast("bigint"), F.lit(10)) + 1).cast("int").alias("fold"),
                    F.pmod((F.col("vec_id") / 30).cast("bigint"), F.lit(2)).alias("half"), "label")
    val = rows.where("half = 1").withColumn("layer", F.col("layer").cast("int"))
    return W.masked_cross_entropy(val, ["layer", "seed", "fold"]).withColumnRenamed("loss", "val_loss")


def _layer_scores(spark, d, losses=None):
    s = M.classification_scores(_layer_preds(spark, d), ["layer", "seed", "fold", "split"])
    return M.fold_scores(s, ["layer", "seed", "fold"], "split", ["accuracy", "macro_f1", "mcc"], losses)


_FS_COLS = [f"{s}_{m}" for s in ("val", "test") for m in ("accuracy", "macro_f1", "mcc")]


@register("layer_scores", f"""WITH {_cls_sql(LAYER_SRC, ['layer', 'seed', 'fold', 'split'])},
fs AS (SELECT layer, seed, fold, """ + ", ".join(
    f"max(CASE WHEN split = '{c.split('_', 1)[0]}' THEN {c.split('_', 1)[1]} END) AS {c}" for c in _FS_COLS) + """
       FROM scores GROUP BY layer, seed, fold),
z AS (SELECT CAST(l AS INTEGER) AS layer, CAST(vec_id % 3 AS INTEGER) AS seed, CAST((vec_id // 3) % 10 + 1 AS INTEGER) AS fold, label,
             CAST(embedding[l * 16 + 1:l * 16 + 16] AS DOUBLE[]) AS x
      FROM embeddings, (SELECT unnest(range(4)) AS l) ll WHERE (vec_id // 30) % 2 = 1),
lo AS (SELECT layer, seed, fold, avg(ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[label + 1]) AS val_loss
       FROM z GROUP BY layer, seed, fold)
SELECT layer, seed, fold, round(val_loss, 6) + 0.0 AS val_loss, """ + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _FS_COLS) + """
FROM fs LEFT JOIN lo USING (layer, seed, fold)""")
def layer_scores(spark, d):
    """M7: one row per (layer, seed, fold) with val_loss, val_* and test_* scores."""
    fs = _layer_scores(spark, d, _layer_losses(spark, d))
    return fs.select("layer", "seed", "fold", r6("val_loss").alias("val_loss"), *[r6(c).alias(c) for c in _FS_COLS])


@register("layer_selection", f"""WITH {_cls_sql(LAYER_SRC, ['layer', 'seed', 'fold', 'split'])},
fs AS (SELECT layer, seed, fold, max(CASE WHEN split = 'val' THEN macro_f1 END) AS val_macro_f1,
              max(CASE WHEN split = 'test' THEN macro_f1 END) AS test_macro_f1 FROM scores GROUP BY ALL),
lm AS (SELECT layer, avg(test_macro_f1) AS test_mean, avg(val_macro_f1) AS val_mean FROM fs WHERE layer >= 1 GROUP BY layer),
b AS (SELECT layer, test_mean FROM lm ORDER BY val_mean DESC, layer ASC LIMIT 1)
SELECT round((SELECT avg(test_mean) FROM lm), 6) + 0.0 AS mean_over_layers, CAST(b.layer AS INTEGER) AS selected_layer,
       round(b.test_mean, 6) + 0.0 AS selected_test FROM b""")
def layer_selection(spark, d):
    """Per-layer means (layers >= 1), their mean, and the layer picked on validation
    macro F1 (the classification primary metric)."""
    metric = M.primary_metric("classification")
    sel = M.select_layer(M.layer_means(_layer_scores(spark, d), metric))
    return sel.select(r6("mean_over_layers").alias("mean_over_layers"), F.col("selected_layer").cast("int"),
                      r6("selected_test").alias("selected_test"))


@register("epoch_scores", f"""WITH {_cls_sql(LAYER_SRC.replace('AS layer', 'AS epoch'), ['epoch'])}
SELECT epoch, round(accuracy, 6) + 0.0 AS acc, round(mcc, 6) + 0.0 AS mcc, round(macro_f1, 6) + 0.0 AS macro_f1 FROM scores""")
def epoch_scores(spark, d):
    """Test scores after each epoch (layers stand in for epochs)."""
    p = _layer_preds(spark, d).withColumnRenamed("layer", "epoch")
    s = M.epoch_scores(p)
    return s.select("epoch", *[r6(c).alias(c) for c in ("acc", "mcc", "macro_f1")])


@register("result_record")
def result_record(spark, d):
    """The nested per-run record (no SQL oracle: nested output); the validation error rate stands in for the loss."""
    p = _layer_preds(spark, d).withColumnRenamed("layer", "epoch")
    loss = p.where("split = 'val'").groupBy("epoch").agg(F.avg((F.col("y") != F.col("p")).cast("double")).alias("val_loss"))
    return M.result_record(M.epoch_scores(p.where("split = 'test'")).join(loss, "epoch"), "bag-of-dims", "lang", 0)


BAG_DIM = 64


def bag_of_tokens_model(dim: int):
    """A stand-in encoder for V10: the histogram of each window's token ids modulo ``dim`` (mean one-hot over the
    unmasked positions). Real models are passed the same way."""
    def make():
        import numpy as np

        def predict(ids, mask):
            out = np.zeros((ids.shape[0], dim), dtype=np.float64)
            rows = np.repeat(np.arange(ids.shape[0]), ids.shape[1])
            np.add.at(out, (rows, ids.ravel() % dim), mask.ravel())
            return out / np.maximum(mask.sum(1, keepdims=True), 1)
        return predict
    return make


@register("embed_pool_probe")
def embed_pool_probe(spark, d):
    """V10 -> V7 -> P3/P6 -> Q1 -> Q2 -> M7: the layer-sweep job end to end with a bag-of-tokens
    encoder: windows are embedded in batches of 24, averaged per sequence, split into seeded
    stratified folds, standardised on each fold's train rows and probed by a two-layer network per
    (seed, fold) that stops on its validation loss. No SQL oracle (iterative fit)."""
    from seqlake.plans.tokens import CONTEXT, _encoded
    enc, _ = _encoded(spark, d)
    win = W.windows(enc.select("seq_id", "input_ids"), CONTEXT)
    emb = V.embed_windows(win.select("seq_id", "window_no", "input_ids"), bag_of_tokens_model(BAG_DIM),
                          BAG_DIM, batch_size=24, keys=["seq_id", "window_no"])
    pooled = settle(V.pool_windows(emb, ["seq_id"]))      # read twice, embedded once
    docs = _docs(spark, d).withColumnRenamed("row_id", "seq_id")
    roles = settle(P.fold_table(P.stratified_kfold(docs.withColumnRenamed("seq_id", "row_id"), K), K)
                   .withColumnRenamed("row_id", "seq_id"))
    scale = Q.run_scale(pooled, roles, ["seed", "fold"], "seq_id")     # the runs share their rows, which are written once
    feats = pooled.withColumnRenamed("vec", "x").join(docs.select("seq_id", "y"), "seq_id")
    preds = Q.fit_probes(feats.withColumnRenamed("seq_id", "row_id"), ["seed", "fold"], classification=True,
                         roles=roles.withColumnRenamed("seq_id", "row_id"), scale=scale)
    preds = preds.withColumn("y", F.col("y").cast("int")).withColumn("p", F.col("pred").cast("int"))
    s = M.classification_scores(preds, ["seed", "fold", "role"])
    loss = preds.groupBy("seed", "fold").agg(F.first("val_loss").alias("val_loss"))
    fs = M.fold_scores(s, ["seed", "fold"], "role", ["accuracy", "macro_f1", "mcc"])
    return fs.join(loss, ["seed", "fold"])
