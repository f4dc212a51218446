"""Near-duplicate vectors by lattice hashing.

Every table projects a vector on two random blocks of eight dimensions and decodes each to
the nearest point of the E8 lattice. The pair of points is the vector's cell; it also probes
one neighbouring cell, the one that the nearest facet of either block leads to. Vectors that
meet in a cell are compared by their cosine in double precision. As two vectors may meet in
several cells and tables, a pair counts in the first table, and there in the least cell, that
it shares: every link is seen once, and links are counted, never listed.

Equal vectors of a label form a class first. A cell with many vectors is compared in tiles of
bounded size. A tile returns a count for each vector and, for each group of linked
ones, links to one of them.

Cases: rows with a null id or label, or whose vector is null, empty, zero or holds null or
non-finite components link with nothing; they are their own component and are kept. Vectors of
different lengths do not link. Repeated rows link with each other. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMBERS, cut, group_bounds, join_hot, joined, mix, whole_groups
from .components import connected

TABLES, BLOCKS = 8, 2
#: Length of a unit vector's projection on one block, as a rule: in units in which the lattice's shortest vectors have length sqrt(2).
REACH = 3.0 * 8**0.5 / 8
COSINE = 0.98
TILE = 1024


@functools.lru_cache(maxsize=8)
def projections(dims: int) -> np.ndarray:
    """TABLES x dims x 16: orthonormal rows as far as dims allow."""
    rng = np.random.default_rng(dims)
    out = np.zeros((TABLES, dims, 8 * BLOCKS))
    for t in range(TABLES):
        q = np.linalg.qr(rng.normal(size=(max(dims, 8 * BLOCKS), 8 * BLOCKS)))[0]
        out[t] = q[:dims] * REACH * (max(dims, 8 * BLOCKS) / 8) ** 0.5
    return out


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


_SHORTEST = minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer vectors of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of the even integer vectors and these moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """n x TABLES x 2 hashes: the cell of each unit vector, and the neighbour that it probes."""
    out = np.zeros((len(unit), TABLES, 2), np.uint64)
    for t, p in enumerate(projections(unit.shape[1])):
        x = (unit @ p).reshape(len(unit), BLOCKS, 8)
        home = np.stack([decode(x[:, b]) for b in range(BLOCKS)], 1)
        towards = (x - home) @ _SHORTEST.T
        step, gain = towards.argmax(2), towards.max(2)
        block = gain.argmax(1)
        probe = home.copy()
        i = np.arange(len(unit))
        probe[i, block] += _SHORTEST[step[i, block]]
        seed = mix(label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 1009 + unit.shape[1]))
        for k, points in enumerate((home, probe)):
            h = seed.copy()
            for c in np.rint(2 * points).astype(np.int64).reshape(len(unit), -1).T:
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + c.view(np.uint64))
            out[:, t, k] = h
    return out


def _links(cell: int, side: np.ndarray, node: np.ndarray, copies: np.ndarray, vec: np.ndarray, keys: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """u, v, links of one tile: for u = v a number of linked vectors, else a link."""
    norm = np.sqrt((vec * vec).sum(1))
    i, j = np.nonzero(np.triu(vec @ vec.T >= (cosine - 1e-9) * np.outer(norm, norm), 1))
    ok = (side[i] != side[j]) | (side[i] == 2)
    i, j = i[ok], j[ok]
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 15):
        a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        sure = (vec[a] * vec[b]).sum(1) / (norm[a] * norm[b]) >= cosine
        least = np.full((len(a), TABLES), np.iinfo(np.uint64).max)
        for x in range(2):
            for y in range(2):
                same = keys[a, :, x] == keys[b, :, y]
                least = np.where(same, np.minimum(least, keys[a, :, x]), least)
        first = (least != np.iinfo(np.uint64).max).argmax(1)
        keep[lo : lo + (1 << 15)] = sure & (least[np.arange(len(a)), first] == np.uint64(cell))
    i, j = i[keep], j[keep]
    n = len(node)
    count = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    root = joined(np.arange(n), i, j)
    moved, some = np.flatnonzero(root != np.arange(n)), np.flatnonzero(count)
    return np.concatenate((node[some], node[moved])), np.concatenate((node[some], node[root[moved]])), np.concatenate((count[some].astype(np.int64), np.zeros(len(moved), np.int64)))


def _compare(members: DataFrame, cosine: float) -> DataFrame:
    """members: tile, cell, side, node, copies, vec, keys."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        tile, cell, side, node, copies = (t[c].to_numpy() for c in ("tile", "cell", "side", "node", "copies"))
        vec, keys = t["vec"].to_pylist(), t["keys"].to_pylist()
        found = [(np.zeros(0, np.int64),) * 3]
        for a, b in group_bounds(tile):
            if b - a > 1:
                v = np.frombuffer(b"".join(vec[a:b]), np.float64).reshape(b - a, -1)
                k = np.frombuffer(b"".join(keys[a:b]), np.uint64).reshape(b - a, TABLES, 2)
                found.append(_links(int(cell[a]) & ((1 << 64) - 1), side[a:b], node[a:b], copies[a:b], v, k, cosine))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, "tile"):
            yield compare(held)

    dealt = members.repartition("tile").sortWithinPartitions("tile")
    return dealt.select("tile", "cell", "side", "node", "copies", "vec", "keys").mapInArrow(run, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    # Labels of any type are told apart by a hash of their own values.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.exists("x", lambda v: v != 0)
    # NaN fails every range, so that only finite components pass.
    good &= ~F.exists("x", lambda v: v.isNull() | ~((v > -float("inf")) & (v < float("inf")) & ~F.isnan(v)))
    rows = rows.withColumn("x", F.when(F.coalesce(good, F.lit(False)), F.transform("x", lambda v: v + F.lit(0.0))))
    rows = rows.withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("label", "x")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, label = b["x"], b["label"].to_numpy()
            size = pa.compute.list_value_length(x).to_numpy()
            flat = x.flatten().to_numpy()
            at = np.cumsum(size) - size
            vec, keys = [b""] * len(x), [b""] * len(x)
            for d in np.unique(size):
                i = np.flatnonzero(size == d)
                v = np.ascontiguousarray(flat[at[i][:, None] + np.arange(d)])
                # Scaled first, so that no square overflows or vanishes; the cosine stays as it is.
                v = v / np.abs(v).max(1, keepdims=True)
                k = cells(v / np.sqrt((v * v).sum(1, keepdims=True)), label[i])
                for n, a, c in zip(i.tolist(), v, k, strict=True):
                    vec[n], keys[n] = a.tobytes(), c.tobytes()
            cell = [np.frombuffer(k, np.int64) for k in keys]
            yield pa.RecordBatch.from_arrays([b["node"], b["copies"], b["rep"], pa.array(vec, pa.binary()), pa.array(keys, pa.binary()), pa.array(cell, pa.list_(pa.int64()))], names=["node", "copies", "rep", "vec", "keys", "cells"])

    classes = rows.where("x IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    total = vectors.count()
    classes = cut(classes.mapInArrow(hashed, "node long, copies long, rep long, vec binary, keys binary, cells array<long>"), total, 20_000)
    placed = classes.select("node", F.explode(F.array_distinct("cells")).alias("cell"))
    full = placed.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    n = F.ceil(F.col("members") / TILE).cast("int")
    placed = placed.join(full, "cell").withColumn("n", n).withColumn("mine", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tile = F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).cast("long")
    members = placed.select(tile.alias("tile"), "cell", side.alias("side"), "node").join(classes.drop("cells", "rep"), "node")
    found = cut(_compare(members, cosine), 4 * TABLES * total)

    links = found.where("u = v").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    label = connected(found.where("u != v").select("u", "v"), 2 * TABLES * total)
    named = classes.select("node", "copies", "rep").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named, total)
    least = named.groupBy("component").agg(F.min("rep").alias("found"), F.count("*").alias(MEMBERS))
    named = join_hot(named, least, ["component"], total).join(links, "node", "left").select("node", "copies", F.col("copies").alias(MEMBERS), "found", F.coalesce("links", F.lit(0)).alias("links"))
    # Rows that link with nothing have no node, and need no join.
    slim = rows.select("vec_id", "node")
    out = join_hot(slim.where("node IS NOT NULL"), cut(named, total), ["node"], total)
    nothing = {"copies": F.lit(1).cast("long"), "found": F.lit(None).cast("long"), "links": F.lit(0).cast("long")}
    out = out.unionByName(slim.where("node IS NULL").withColumns(nothing).select(*out.columns))
    component = F.coalesce("found", "vec_id")
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98
), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a
), c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
