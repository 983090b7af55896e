"""Embedding near-duplicates: int8 tile products with error bounds, full precision where they leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components, merged_labels

TILE = 1024


class Tile:
    """Unit vectors in double precision, their int8 form and the norm of what that leaves out."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray):
        self.ids, self.copies, self.unit = ids, copies, unit
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        approx = self.q * self.scale[:, None]
        self.size = np.linalg.norm(approx, axis=1) * (1 + 1e-12)
        self.error = np.linalg.norm(unit - approx, axis=1) * (1 + 1e-12) + 1e-14
        c = unit.sum(axis=0)
        n = np.linalg.norm(c)
        self.center = c / n if n > 0 else unit[0]
        self.radius = float(np.arccos(np.clip(unit @ self.center, -1, 1)).max())


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def tile_links(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) with cosine >= threshold.

    With x = s q + e and y = t p + f: |x.y - s t (q.p)| <= |s q||f| + |e||t p| + |e||f|. The bound is taken as a sum of
    a part of the row and a part of the column; only pairs that may reach the threshold are computed in full.
    """
    if np.arccos(np.clip(a.center @ b.center, -1, 1)) - a.radius - b.radius > np.arccos(threshold) + 1e-6:
        return np.empty(0, np.int64), np.empty(0, np.int64)  # by the triangle inequality of angles
    exact = np.float32 if a.q.shape[1] <= 1000 else np.float64  # in which sums of products of int8 are exact
    product = a.q.astype(exact) @ b.q.astype(exact).T
    product *= (a.scale[:, None]).astype(product.dtype)
    product *= b.scale.astype(product.dtype)
    row = a.error * b.size.max()
    col = b.error * (a.size.max() + a.error.max())
    product += row[:, None].astype(product.dtype)
    product += col.astype(product.dtype)
    i, j = np.nonzero(product >= threshold - 2e-6)  # and what float32 rounds
    if not len(i):
        return i, j
    keep = np.concatenate([np.einsum("ij,ij->i", a.unit[i[k : k + 32768]], b.unit[j[k : k + 32768]]) >= threshold for k in range(0, len(i), 32768)])
    return i[keep], j[keep]


def _tiles(ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> list[Tile]:
    """Tiles of neighbours: rows sorted by the nearest of a few of them, so that angles can rule tiles out."""
    unit = unit_vectors(x)
    if len(ids) > TILE:
        near = unit @ unit[:: max(1, len(ids) // 32)].T
        order = np.lexsort((-near.max(axis=1), near.argmax(axis=1)))
        ids, copies, unit = ids[order], copies[order], unit[order]
    return [Tile(ids[k : k + TILE], copies[k : k + TILE], unit[k : k + TILE]) for k in range(0, len(ids), TILE)]


def link_vectors(vectors: DataFrame, *, threshold: float = 0.9, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links, component_id (smallest id reachable by links), kept.

    Vectors are linked when their cosine, in double precision, reaches the threshold. Equal vectors first become one
    class with a count. Classes are dealt by a hash into blocks of about `block`; each pair of blocks is a task of
    tile products. A task returns the links of each vector as a count and its links as a spanning forest, so that a
    dense cluster gives rows in proportion to vectors, not to pairs. All pairs are covered; the work is quadratic in
    different vectors, less the tiles that angles rule out.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different length. Ids must be integers. An empty table gives an empty one. A null id links with nothing (component null, kept). Rows that repeat an id and a vector count
    as rows of their own. Extra columns are not read.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("x", F.when(F.coalesce(finite, F.lit(False)) & F.col("id").isNotNull(), F.transform("x", lambda v: v + 0.0)))
    classes = stored(rows.filter("x is not null").groupBy("x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    groups = max(1, -(-classes.count() // block))
    id_type = classes.schema["rep"].dataType.simpleString()

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        flat = t.column("x").combine_chunks().flatten().to_numpy()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([key[1].as_py()], pa.int64()), "ids": [t.column("rep").to_numpy().astype(np.int64).tobytes()], "copies": [t.column("copies").to_numpy().astype(np.int64).tobytes()], "xs": [flat.tobytes()]})

    dealt = classes.select(F.size("x").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(groups)).alias("g"), F.col("rep").cast("long").alias("rep"), "copies", "x")
    blocks = stored(dealt.groupBy("dim", "g").applyInArrow(pack, "dim int, g long, ids binary, copies binary, xs binary"), "blocks")
    sent = blocks.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def multiply(key: tuple, t: pa.Table) -> pa.Table:
        dim, lo, hi = (k.as_py() for k in key)
        sides = {}
        for r in t.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            sides[r["g"]] = _tiles(ids, np.frombuffer(r["copies"], np.int64), np.frombuffer(r["xs"], np.float64).reshape(len(ids), dim))
        if lo not in sides or hi not in sides:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        a, b = sides[lo], sides[hi]
        tiles = a if lo == hi else a + b
        starts = np.cumsum([0, *(len(x.ids) for x in tiles)])
        ids = np.concatenate([x.ids for x in tiles])
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for m in range(len(a)):
            for k in range(m if lo == hi else 0, len(b)):
                i, j = tile_links(a[m], b[k], threshold)
                n = k if lo == hi else len(a) + k
                if n == m:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    links[starts[m] : starts[m + 1]] += np.bincount(i, b[k].copies[j], len(a[m].ids)).astype(np.int64)
                    links[starts[n] : starts[n + 1]] += np.bincount(j, a[m].copies[i], len(b[k].ids)).astype(np.int64)
                    label = merged_labels(label, i + starts[m], j + starts[n])
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": ids[label[some]]})

    found = stored(sent.groupBy("dim", F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi")).applyInArrow(multiply, "id long, links long, root long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    per = classes.join(counts, "rep", "left").join(labels, "rep", "left").select("x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").cast(id_type).alias("component_id"))
    out = rows.join(per, "x", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
