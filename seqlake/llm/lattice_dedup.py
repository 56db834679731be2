"""Embedding near-dedup: lattice hashing.

Unit vectors are turned by a fixed random rotation, whose output is cut into groups of eight
coordinates: each is one table's projection. Two unit vectors of cosine ``c`` are sqrt(2 - 2c)
apart, and a rotation keeps that distance, so in at least one of the ``m`` tables their
projections are no more than that over sqrt(m) apart. Each projection is decoded to its nearest point
of the scaled E8 lattice; the vector is entered in that cell and in the neighbouring cells that the ball of half
that distance reaches. Then two such vectors meet in a cell for certain: candidate search loses
no link. Vectors that meet are verified by cosine in double precision.

Equal vectors of a label are one node with a count, so a vector that a third of all rows share
costs one row. Cells with more than ``CELL_ROWS`` vectors are divided into chunks, and each pair of
chunks is verified on its own. Verifying groups take ``ROWS_PER_BUCKET`` rows on average, counted after
that division.

Defined results: vectors without label, null or empty vectors and such that hold a null, NaN or
infinity or only zeros link with nothing and are their own component; vectors of different
length never link; repeated rows are separate vectors (their links count); a null vec_id never
names a component (a component of null ids has a null id and is not kept); an empty table gives an
empty table; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import small_batches
from seqlake.llm.components import components
from seqlake.session import settle

CELL_ROWS = 1024        # vectors of a cell that are verified against each other at once
ROWS_PER_BUCKET = 16384  # entries that go to one verifying group, on average
SCALE = 0.2             # of the lattice, for unit vectors
SEED = 8
PAIRS_AT_ONCE = 1 << 15
MOST_REACH = 0.43       # of a ball, in units of the scale: see neighbours()


@lru_cache(maxsize=1)
def neighbours() -> tuple[np.ndarray, np.ndarray]:
    """The E8 vectors of squared length 2 and 4 and these squared lengths: no other cell is reached by a ball of
    radius under 0.44 around a point of the cell of the origin."""
    out = set()
    for n, value in ((2, 1.0), (4, 1.0), (1, 2.0)):
        for at in combinations(range(8), n):
            for sign in product((-1, 1), repeat=n):
                v = [0.0] * 8
                for i, s in zip(at, sign):
                    v[i] = s * value
                out.add(tuple(v))
    for sign in product((-0.5, 0.5), repeat=8):
        if sum(x < 0 for x in sign) % 2 == 0:
            out.add(sign)
    for i in range(8):
        for sign in product((-0.5, 0.5), repeat=8):
            v = list(sign)
            v[i] *= 3
            if sum(v) % 2 == 0:
                out.add(tuple(v))
    table = np.array(sorted(out))
    return table, (table ** 2).sum(axis=1)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) % 2)
    off = x[odd] - r[odd]
    worst = np.abs(off).argmax(axis=1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice points of the rows of ``x``."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal map of ``dim`` coordinates into the next multiple of eight."""
    q, _ = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((-(-dim // 8) * 8,) * 2))
    return q[:dim]


def lattice_scale(dim: int, cosine: float, least: float) -> float:
    """The lattice's scale: ``least``, or as much more as keeps a ball's reach inside the next cells (few tables)."""
    tables = -(-dim // 8)
    return max(least, math.sqrt(2 - 2 * cosine) / math.sqrt(tables) / 2 / MOST_REACH)


def cells(unit: np.ndarray, cosine: float, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, table, cell as eight doubled coordinates) of all entries of the unit vectors ``unit``."""
    scale = lattice_scale(unit.shape[1], cosine, scale)
    z = (unit @ rotation(unit.shape[1])).reshape(-1, 8) / scale
    tables = len(z) // len(unit)
    reach = (math.sqrt(2 - 2 * cosine) / math.sqrt(tables) / 2) * (1 + 1e-9) / scale + 1e-9
    home = decode_e8(z)
    vectors, squares = neighbours()
    # the plane halfway to a neighbouring lattice point is no farther than the ball reaches
    touched, v = np.nonzero((z - home) @ vectors.T >= squares / 2 - reach * np.sqrt(squares))
    owner = np.r_[np.arange(len(z)), touched]
    points = np.r_[home, home[touched] + vectors[v]]
    return owner // tables, owner % tables, (2 * points).astype(np.int16)


def usable(embedding: Column) -> Column:
    """Whether a vector can link at all."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def entries(nodes: DataFrame, cosine: float, scale: float) -> DataFrame:
    """(node, label, dim, cell): the entries of ``nodes`` (node, label, v array<double>) in all tables."""
    small_batches(nodes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = pdf["v"].map(lambda v: np.asarray(v, dtype=float))
            sizes = vectors.map(len).to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                m = np.stack(vectors.iloc[at].tolist())
                row, table, cell = cells(_unit(m), cosine, scale)
                cell = np.ascontiguousarray(np.c_[table.astype(np.int16), cell])
                yield pd.DataFrame({"node": pdf["node"].to_numpy()[at[row]], "label": pdf["label"].to_numpy()[at[row]],
                                    "dim": np.int32(dim), "cell": [c.tobytes() for c in cell]})

    return nodes.select("node", "label", "v").mapInPandas(run, "node bigint, label bigint, dim int, cell binary")


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _meeting(unit_a: np.ndarray, unit_b: np.ndarray, cosine: float, scale: float) -> np.ndarray:
    """(table, doubled cell) where a linked pair counts: the table in which its projections are closest, and there
    the cell of the point halfway, which both are entered in."""
    turn, scale = rotation(unit_a.shape[1]), lattice_scale(unit_a.shape[1], cosine, scale)
    a, b = ((u @ turn).reshape(len(u), -1, 8) / scale for u in (unit_a, unit_b))
    table = ((a - b) ** 2).sum(axis=2).argmin(axis=1)
    at = np.arange(len(a))
    return np.c_[table, 2 * decode_e8((a[at, table] + b[at, table]) / 2)].astype(np.int16)


def verify(cosine: float, scale: float):
    """Grouped function: the pairs of a bucket that have the cosine, each in the one cell where it counts."""
    def pairs(unit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
        found = [np.zeros((2, 0), dtype=np.int64)]
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a > 1:
                found.append(a + np.stack(np.nonzero(np.triu(unit[a:b] @ unit[a:b].T >= cosine - 1e-9, 1))))
        return tuple(np.concatenate(found, axis=1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same_length in pdf.groupby(pdf["v"].map(len)):
            rows = same_length.sort_values("cell_id", kind="stable")
            m = np.array(rows["v"].tolist(), dtype=float)
            unit, cell = _unit(m), np.frombuffer(b"".join(rows["cell"]), dtype=np.int16).reshape(-1, 9)
            node, label, chunk, lone = (rows[c].to_numpy() for c in ("node", "label", "chunk", "one_chunk"))
            i, j = pairs(unit, rows["cell_id"].to_numpy())
            keep = (node[i] != node[j]) & (label[i] == label[j]) & (lone[i] | (chunk[i] != chunk[j]))
            i, j = i[keep], j[keep]
            norm = np.sqrt((m * m).sum(axis=1))
            for at in range(0, len(i), PAIRS_AT_ONCE):
                x, y = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
                near = (m[x] * m[y]).sum(axis=1) / (norm[x] * norm[y]) >= cosine
                x, y = x[near], y[near]
                here = (_meeting(unit[x], unit[y], cosine, scale) == cell[x]).all(axis=1)
                p, q = node[x[here]], node[y[here]]
                out.append(pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")
    return run


def bucket_count(shared: DataFrame) -> int:
    """Verifying groups for the cells of ``shared`` (n, chunks): their rows are counted as dealt, each once per chunk."""
    return 1 + shared.agg(F.coalesce(F.sum(F.col("n") * F.col("chunks")), F.lit(0))).first()[0] // ROWS_PER_BUCKET


def near_links(nodes: DataFrame, cosine: float, scale: float) -> DataFrame:
    """Distinct (a, b): the nodes of a label at the cosine or above."""
    placed = settle(entries(nodes, cosine, scale))
    cell = ["label", "dim", "cell"]
    shared = settle(placed.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1")
                    .select(*cell, "n", F.when(F.col("n") > CELL_ROWS, F.ceil(F.col("n") / (CELL_ROWS // 2))).otherwise(1)
                            .cast("int").alias("chunks")))
    dealt = (placed.join(shared.drop("n"), cell).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("cell_id", F.xxhash64(*cell, F.least("chunk", "other"), F.greatest("chunk", "other")))
             .select("node", "label", "cell", "chunk", (F.col("chunk") == F.col("other")).alias("one_chunk"), "cell_id"))
    buckets = bucket_count(shared)
    return (dealt.join(nodes.select("node", "v"), "node")
            .groupBy(F.pmod("cell_id", F.lit(buckets)).alias("bucket"))
            .applyInPandas(verify(cosine, scale), "a bigint, b bigint"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, scale: float = SCALE, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                          F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))    # no negative zeros
    able = F.col("label").isNotNull() & usable(F.col("v"))
    keyed = rows.withColumn("h1", F.when(able, F.xxhash64("label", "v"))).withColumn(
        "h2", F.when(able, F.xxhash64(F.lit(SEED), "v", "label")))
    nodes = settle(keyed.where(able).groupBy("h1", "h2").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()))
    links = settle(near_links(nodes, cosine, scale))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = (both.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node"))
              .agg(F.sum("n").alias("others")))
    roots = components(links).withColumnRenamed("node", "member")
    grouped = (nodes.select("h1", "h2", "low", "n", "node").join(roots, F.col("node") == F.col("member"), "left")
               .withColumn("root", F.coalesce("root", "node")))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    result = settle(grouped.join(lowest, "root").join(degree, "node", "left")
                    .select("h1", "h2", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    ids = keyed.select("vec_id", "h1", "h2")
    linked = ids.where("h1 is not null").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = ids.where("h1 is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
