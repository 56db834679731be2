"""Vector queries (V1, V3, V5-V9, V11, V12) over the embeddings table read as token vectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.functions.vectors import has_nan, l2_normalise, norm
from seqlake.operators import vectors as V
from seqlake.plans.registry import r6, register
from seqlake.sources import views

LAYERS, WIDTH = 4, 16

TOK_CTE = """t AS (SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, vec_id, label, embedding,
                  CASE WHEN vec_id % 8 < 8 - ((vec_id // 8) % 3) THEN 1 ELSE 0 END AS mask FROM embeddings),
x AS (SELECT seq_id, pos, mask, i // 16 AS layer, i % 16 AS dim, CAST(embedding[i + 1] AS DOUBLE) AS v
      FROM (SELECT *, unnest(range(64)) AS i FROM t))"""


def _tokens(spark, d):
    t = views.token_vectors(spark, d)
    t = t.withColumn("mask", F.when(F.col("pos") < 8 - F.pmod(F.col("seq_id"), F.lit(3)), 1).otherwise(0))
    layers = F.transform(F.sequence(F.lit(0), F.lit(LAYERS - 1)), lambda l: F.slice("embedding", l * WIDTH + 1, WIDTH))
    return V.explode_layers(t.withColumn("layers", layers), ["seq_id", "pos", "mask"])


@register("mean_pool", f"""WITH {TOK_CTE}
SELECT seq_id, CAST(layer AS INTEGER) AS layer, CAST(dim AS INTEGER) AS dim, round(sum(v * mask) / sum(mask), 6) + 0.0 AS v
FROM x GROUP BY seq_id, layer, dim""")
def mean_pool(spark, d):
    """V11 + V5: layers from the hidden vector, mean over unmasked positions."""
    out = V.long_form(V.mean_pool(_tokens(spark, d), ["seq_id", "layer"], mask="mask"), ["seq_id", "layer"])
    return out.select("seq_id", "layer", F.col("dim").cast("int"), r6("v").alias("v"))


@register("last_token_pool", f"""WITH {TOK_CTE},
lastpos AS (SELECT seq_id, greatest(sum(mask) - 1, 0) AS lp FROM t GROUP BY seq_id)
SELECT x.seq_id, CAST(layer AS INTEGER) AS layer, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS v
FROM x JOIN lastpos l ON x.seq_id = l.seq_id AND x.pos = l.lp""")
def last_token_pool(spark, d):
    """V6: the vector of the last unmasked token."""
    out = V.last_token_pool(_tokens(spark, d), ["seq_id", "layer"], vec="vec", mask="mask")
    return out.select("seq_id", "layer", F.posexplode("vec").alias("dim", "v")) \
        .select("seq_id", "layer", F.col("dim").cast("int"), r6(F.col("v").cast("double")).alias("v"))


@register("pool_windows", f"""WITH {TOK_CTE},
w AS (SELECT seq_id, layer, dim, sum(v * mask) / sum(mask) AS v FROM x GROUP BY seq_id, layer, dim)
SELECT seq_id // 4 AS parent, CAST(layer AS INTEGER) AS layer, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS v
FROM w GROUP BY 1, 2, 3""")
def pool_windows(spark, d):
    """V5 + V7: token means per window (8 tokens), then unweighted means over 4 windows."""
    w = V.mean_pool(_tokens(spark, d), ["seq_id", "layer"], mask="mask")
    w = w.withColumn("parent", (F.col("seq_id") / 4).cast("bigint"))
    out = V.long_form(V.pool_windows(w, ["parent", "layer"]), ["parent", "layer"])
    return out.select("parent", "layer", F.col("dim").cast("int"), r6("v").alias("v"))


@register("pool_assembly", """
WITH r AS (SELECT vec_id AS row_id, label, embedding,
                  CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(vec_id // 5 AS VARCHAR) END AS assembly FROM embeddings),
i AS (SELECT *, min(row_id) OVER (PARTITION BY coalesce(assembly, 'row ' || row_id), assembly IS NULL) AS first_row FROM r),
f AS (SELECT first_row, count(*) AS n_rows, arg_min(label, row_id) AS label FROM i GROUP BY first_row),
x AS (SELECT first_row, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS v FROM i)
SELECT x.first_row, f.n_rows, f.label, CAST(x.dim AS INTEGER) AS dim, round(avg(x.v), 6) + 0.0 AS v
FROM x JOIN f ON x.first_row = f.first_row GROUP BY x.first_row, f.n_rows, f.label, x.dim""")
def pool_assembly(spark, d):
    """V8: contigs averaged per assembly (assembly = vec_id div 5, none for every 11th row)."""
    e = views.table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("row_id"), "label",
                    F.when(F.pmod("vec_id", F.lit(11)) == 0, F.lit(None)).otherwise((F.col("vec_id") / 5).cast("bigint").cast("string"))
                    .alias("assembly"), F.col("embedding").alias("vec"))
    out = V.long_form(V.pool_assembly(rows, carry=["label"]), ["first_row", "n_rows", "label"])
    return out.select("first_row", "n_rows", "label", F.col("dim").cast("int"), r6("v").alias("v"))


@register("l2_normalise", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS nrm FROM e),
u AS (SELECT vec_id, nrm, list_transform(v, lambda x: CAST(CAST(x / greatest(nrm, 1e-12) AS FLOAT) AS DOUBLE)) AS uv FROM n)
SELECT vec_id, round(nrm, 6) AS norm_in, abs(nrm - 1) <= 0.01 AND len(uv) = 64 AS unit_ok,
       round(sqrt(list_inner_product(uv, uv)), 6) AS norm_out, list_bool_or(list_transform(uv, lambda x: isnan(x))) AS has_nan
FROM u""")
def l2_normalise_q(spark, d):
    """V1 + V3 + V9: unit vectors, the unit-norm check and the NaN guard."""
    e = views.table(spark, d, "embeddings")
    u = e.select("vec_id", norm("embedding").alias("nrm"), V.check_unit("embedding", 1e-2, 64).alias("unit_ok"),
                 l2_normalise("embedding").alias("uv"))
    u = V.nan_guard(u, "uv", "vec_id")
    return u.select("vec_id", F.round("nrm", 6).alias("norm_in"), "unit_ok",
                    F.round(norm("uv"), 6).alias("norm_out"), has_nan("uv").alias("has_nan"))


@register("running_standardise", """
WITH b AS (SELECT vec_id // 32 AS batch, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
s AS (SELECT batch, dim, count(*) AS n, avg(x) AS m, greatest(stddev_samp(x), 0.001) AS sd FROM b GROUP BY batch, dim),
k AS (SELECT batch, row_number() OVER (ORDER BY batch) AS k FROM (SELECT DISTINCT batch FROM s WHERE n >= 2)),
kk AS (SELECT count(*) AS bigk FROM k),
w AS (SELECT s.dim, s.m, s.sd,
             CASE WHEN bigk <= 100 THEN 1.0 / bigk
                  WHEN k.k <= 100 THEN (1.0 / 100) * pow(0.99, bigk - 100)
                  ELSE 0.01 * pow(0.99, bigk - k.k) END AS wt
      FROM s JOIN k ON s.batch = k.batch, kk)
SELECT CAST(dim AS INTEGER) AS dim, round(sum(wt * m), 6) AS mu, round(sum(wt * sd), 6) AS sd FROM w GROUP BY dim""")
def running_standardise(spark, d):
    """EMA feature statistics over ordered batches of 32 rows (state after the last batch)."""
    e = views.table(spark, d, "embeddings").select((F.col("vec_id") / 32).cast("bigint").alias("batch"),
                                                     "vec_id", F.col("embedding").alias("vec"))
    _, table = V.running_standardise(e, "batch", keys=["vec_id"])
    return table.select(F.col("dim").cast("int"), F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"))


@register("running_states", """
WITH b AS (SELECT vec_id // 7 AS batch, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x
           FROM embeddings WHERE vec_id % 7 < 1 + (vec_id // 7) % 5),
s AS (SELECT batch, dim, count(*) AS n, avg(x) AS m, greatest(stddev_samp(x), 0.001) AS sd FROM b GROUP BY batch, dim),
c AS (SELECT dim, batch, n, list(m) FILTER (n >= 2) OVER w AS ms, list(sd) FILTER (n >= 2) OVER w AS sds
      FROM s WINDOW w AS (PARTITION BY dim ORDER BY batch)),
z AS (SELECT batch, dim, len(ms) AS k,
             list_reduce(ms, lambda a, x, i: (1 - greatest(1.0 / i, 0.01)) * a + greatest(1.0 / i, 0.01) * x) AS mu,
             list_reduce(sds, lambda a, x, i: (1 - greatest(1.0 / i, 0.01)) * a + greatest(1.0 / i, 0.01) * x) AS sd
      FROM c WHERE len(ms) > 0)
SELECT batch, CAST(dim AS INTEGER) AS dim, k, round(mu, 6) + 0.0 AS mu, round(sd, 6) + 0.0 AS sd FROM z""")
def running_states(spark, d):
    """EMA feature statistics after every batch (batches of one to five rows; those of one row do not count)."""
    e = views.table(spark, d, "embeddings").select((F.col("vec_id") / 7).cast("bigint").alias("batch"), "vec_id", F.col("embedding").alias("vec"))
    e = e.where(F.pmod("vec_id", F.lit(7)) < 1 + F.pmod("batch", F.lit(5)))
    out = V.running_states(e, "batch").where("mu is not null")
    return (out.select("batch", F.col("k").cast("bigint"), F.posexplode(F.arrays_zip("mu", "sd")).alias("dim", "z"))
            .select("batch", F.col("dim").cast("int"), "k", r6("z.mu").alias("mu"), r6("z.sd").alias("sd")))


@register("species_vectors", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: CAST(CAST(x / greatest(sqrt(list_inner_product(v, v)), 1e-12) AS FLOAT) AS DOUBLE)) AS uv, v FROM e),
r AS (SELECT a.vec_id, CASE WHEN a.vec_id % 10 = 0 THEN a.v ELSE t.uv END AS vec
      FROM u a LEFT JOIN u t ON t.vec_id = a.vec_id % 10 - 1)
SELECT vec_id AS seq_id, CAST(dim AS INTEGER) AS dim, round(vec[dim + 1], 6) + 0.0 AS v FROM (SELECT *, unnest(range(64)) AS dim FROM r)""")
def species_vectors(spark, d):
    """V2 + V4: ids 0 to 8 take the unit rows of a table of nine species, -1 the row's inferred vector."""
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("seq_id"), (F.pmod("vec_id", F.lit(10)) - 1).cast("int").alias("species_id"),
                                                     F.col("embedding").alias("vec"))
    table = e.where("seq_id between 0 and 8").select(F.col("seq_id").cast("int").alias("species_id"), "vec")
    out = V.species_vectors(e.select("seq_id", "species_id"), table=table, inferred=e.select("seq_id", "vec"))
    long = out.select("seq_id", F.posexplode("species_vec").alias("dim", "v"))
    return long.select("seq_id", F.col("dim").cast("int"), r6(F.col("v").cast("double")).alias("v"))
