"""Near-duplicate vectors by E8 lattice hashing, verified by cosine in double precision.

Unit vectors are projected at random to blocks of eight dimensions, scaled, and
each block is decoded to the nearest point of the E8 lattice; the points of a
table's blocks are the cell. Several tables use projections of their own, drawn
from a seed. More blocks make cells more selective, for more vectors. Each vector is
filed under its own cell and, as a probe, looks also into the cells of neighbouring
lattice points nearest to it, so a pair meets when either finds the other's cell in
any table.

Equal vectors are one node. Dense groups are not expanded into pairs: a vector within
half the angle of the threshold of the earliest vector of one of its cells falls into
that one's *ball*, and all of a ball are linked by the triangle inequality, which is
a count. Only pairs across balls are candidates; those that differ in too many signs
of random projections (five standard deviations) are dropped where they meet, and the
others are verified once by cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.storage import Scratch, bounded_batches, discard, materialise


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the offsets to neighbouring lattice points."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a in (-1.0, 1.0):
            for b in (-1.0, 1.0):
                v = np.zeros(8)
                v[i], v[j] = a, b
                whole.append(v)
    signs = np.array(np.meshgrid(*[[-0.5, 0.5]] * 8)).reshape(8, -1).T
    return np.concatenate([np.array(whole), signs[(signs < 0).sum(axis=1) % 2 == 0]])


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: round, and where the sum is odd, round the worst the other way."""
    near = np.round(x)
    miss = x - near
    worst = np.abs(miss).argmax(axis=1)
    odd = near.sum(axis=1) % 2 != 0
    rows = np.flatnonzero(odd)
    near[rows, worst[rows]] += np.where(miss[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight: the better of D8 and D8 shifted by a half."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    first = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(first[:, None], a, b)


def projections(dims: int, tables: int, seed: int) -> np.ndarray:
    """Orthonormal eight-dimensional projections; tables share rotations as far as a space has room for eight at a time."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    while len(out) < tables:
        q, _ = np.linalg.qr(rng.normal(size=(max(dims, 8), max(dims, 8))))
        out += [q[:dims, i : i + 8] for i in range(0, q.shape[1] - 7, 8)]
    return np.stack(out[:tables])


def cells(unit: np.ndarray, frames: np.ndarray, blocks: int, scale: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell hashes (vectors, tables) and probed cells (vectors, tables, probes) of neighbouring points."""
    tables, shift = len(frames) // blocks, roots()
    weights = np.random.default_rng(5).integers(1, 1 << 62, (blocks, 8), dtype=np.int64) | 1
    own = np.zeros((len(unit), tables), dtype=np.int64)
    near = np.empty((len(unit), tables, probes), dtype=np.int64)
    grow = np.sqrt(unit.shape[1] / 8) * scale
    steps = np.concatenate([(2 * shift).astype(np.int64) @ w for w in weights])
    for t in range(tables):
        gain = []
        for j in range(blocks):
            x = (unit @ frames[t * blocks + j]) * grow
            point = decode_e8(x)
            own[:, t] += ((2 * point).astype(np.int64) * weights[j]).sum(axis=1)
            # |x - (p + r)|^2 falls as (x - p) . r rises, all roots being of one length.
            gain.append((x - point) @ shift.T)
        best = np.argpartition(-np.concatenate(gain, axis=1), probes, axis=1)[:, :probes]
        near[:, t] = own[:, t][:, None] + steps[best]
    return own, near


def unit_rows(vectors: pa.Array) -> list[np.ndarray | None]:
    """Double precision unit vectors; None for what is null, empty, zero or holds a null or non-finite component."""
    rows: list[np.ndarray | None] = []
    for v in vectors:
        x = v.values if v.is_valid else None
        if x is None or x.null_count or not len(x):
            rows.append(None)
            continue
        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
        most = np.abs(x).max()
        if np.isfinite(most) and most > 0:
            x = x / most  # first, so that no square is over or under the range of a double
            rows.append(x / np.sqrt(x @ x))
        else:
            rows.append(None)
    return rows


def signatures(unit: np.ndarray, seed: int) -> np.ndarray:
    """128 signs of random projections of each row, as two longs: unlike vectors differ in many."""
    planes = np.random.default_rng(seed).normal(size=(unit.shape[1], 128))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def _units(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column("vector"))
            signed = np.zeros((len(rows), 2), dtype=np.int64)
            sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
            for dims in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dims)
                signed[at] = signatures(np.stack([rows[i] for i in at]), seed + int(dims))
            yield pa.record_batch([batch.column("id"), pa.array(rows, pa.list_(pa.float64())), *map(pa.array, signed.T)], names=["id", "unit", "s", "t"])

    return run


def _filed(tables: int, blocks: int, seed: int, scale: float, probes: int) -> Callable:
    """Cells of each vector: its own and the probed ones; own ones alone for no probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames: dict[int, np.ndarray] = {}
        for batch in batches:
            units = [u.values.to_numpy() for u in batch.column("unit")]
            others = [batch.column(c).to_numpy() for c in ("node", "ball", "s", "t")]
            sizes = np.array([len(u) for u in units])
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                if dims not in frames:
                    frames[dims] = projections(int(dims), tables * blocks, seed)
                own, near = cells(np.stack([units[i] for i in rows]), frames[dims], blocks, scale, max(1, probes))
                every = np.concatenate([own[:, :, None], near[:, :, :probes]], axis=2)
                table = np.arange(tables, dtype=np.int64)[None, :, None]
                spread = [np.broadcast_to(x[rows][:, None, None], every.shape).ravel() for x in others]
                filed = np.zeros(every.shape, dtype=bool)
                filed[:, :, 0] = True
                cell = every ^ (table << 56) ^ (int(dims) << 40)
                yield pa.record_batch([pa.array(cell.ravel()), *map(pa.array, spread), pa.array(filed.ravel())], names=["cell", "node", "ball", "s", "t", "filed"])

    return run


def _unlike(x: str, y: str) -> Column:
    """In how many of 128 signs two rows differ."""
    return F.bit_count(F.col(f"{x}.s").bitwiseXOR(F.col(f"{y}.s"))) + F.bit_count(F.col(f"{x}.t").bitwiseXOR(F.col(f"{y}.t")))


def _most_unlike(cosine: float) -> int:
    """Signs in which vectors of this cosine differ, and five standard deviations more."""
    share = np.arccos(min(1.0, cosine)) / np.pi
    return int(np.ceil(128 * share + 5 * np.sqrt(128 * share * (1 - share))))


def _verified(pairs: DataFrame, heads: DataFrame, cosine: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose cosine is at least ``cosine``."""
    left = pairs.join(heads.select(F.col("node").alias("a"), F.col("unit").alias("u")), "a")
    both = left.join(heads.select(F.col("node").alias("b"), F.col("unit").alias("v")), "b")
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.where((F.size("u") == F.size("v")) & (dot >= cosine)).select("a", "b")


def balls(heads: DataFrame, lay: Callable, cosine: float) -> DataFrame:
    """``(node, ball)``, both longs: of vectors near an earlier one of a common cell, the earliest such.

    Near is half the angle of ``cosine``, so any two vectors of one ball are linked.
    """
    close = float(np.cos(np.arccos(cosine) / 2)) + 1e-12
    home = materialise(lay(heads.withColumn("ball", F.col("node")), 0), "homes")
    first = home.groupBy("cell").agg(F.min(F.struct("node", "s", "t")).alias("f"), F.count("*").alias("n")).where("n > 1").select("cell", "f.*")
    first = materialise(first, "firsts")
    met = home.alias("x").join(first.alias("y"), "cell").where((F.col("x.node") != F.col("y.node")) & (_unlike("x", "y") <= _most_unlike(close)))
    pairs = materialise(met.groupBy(F.col("x.node").alias("b")).agg(F.min("y.node").alias("a")), "pairs")
    found = materialise(_verified(pairs, heads, close).select(F.col("b").alias("node"), F.col("a").alias("ball")), "balls")
    discard(home, first, pairs)
    return found


def near_pairs(heads: DataFrame, lay: Callable, probes: int, cosine: float) -> DataFrame:
    """Verified pairs ``(a, b)``, ``a < b``, of rows ``(node, ball, unit, s, t)`` of different balls, written."""
    filed = materialise(lay(heads, probes), "cells")
    met = filed.where("filed").alias("x").join(filed.alias("y"), "cell")
    met = met.where((F.col("x.ball") != F.col("y.ball")) & (_unlike("x", "y") <= _most_unlike(cosine)))
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    links = materialise(_verified(pairs, heads, cosine), "links")
    discard(filed, pairs)
    return links


def lattice_near_dups(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, cosine: float = 0.9, tables: int = 16, blocks: int = 2, probes: int = 1, scale: float = 1.3, seed: int = 11
) -> DataFrame:
    """Return ``(id, n_links, component_id, kept)``, a row for each row of ``vectors``.

    Two vectors link when found and their cosine, in double precision, reaches
    ``cosine``; ``n_links`` counts the other rows so linked, copies too. Null, zero and
    empty vectors, and those with a null or non-finite component, link with nothing.
    Vectors of different lengths never link. Rows are told apart by their vector: rows
    that repeat an id with another vector have links of their own, and rows without an id
    take part as others do. ``component_id`` is the least id of the component, null
    where none has one, and ``kept`` tells that it is the row's own. Labels and other
    columns are ignored. Ids are integers. An empty table gives an empty result.
    """

    def lay(heads: DataFrame, probes: int) -> DataFrame:
        fields = "cell long, node long, ball long, s long, t long, filed boolean"
        return heads.select("node", "ball", "s", "t", "unit").mapInArrow(_filed(tables, blocks, seed, scale, probes), fields)

    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    with Scratch(vectors.sparkSession) as scratch:
        units = rows.mapInArrow(_units(seed), "id long, unit array<double>, s long, t long")
        units = materialise(units.withColumn("key", F.sha2(F.col("unit").cast("string"), 256)), "units")
        known = units.where("unit is not null")
        # One node for each different vector; its number is fixed by being written.
        heads = known.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("unit", "s", "t")))
        heads = materialise(heads.withColumn("node", F.monotonically_increasing_id()), "heads")
        near = balls(heads, lay, cosine)
        placed = materialise(heads.join(near, "node", "left").withColumn("ball", F.coalesce("ball", "node")), "placed")
        pairs = near_pairs(placed, lay, probes, cosine)
        ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
        size = heads.select(F.col("node").alias("other"), "copies")
        links = ends.join(size, "other").groupBy("node").agg(F.sum("copies").alias("links"))
        inside = materialise(placed.groupBy("ball").agg(F.sum("copies").alias("inside")), "inside")
        parts = connected_components(pairs.union(near.select("node", "ball")), "a", "b")
        joined = placed.select("node", "key", "ball", "least").join(inside, "ball").join(links, "node", "left").join(parts, "node", "left")
        joined = joined.select("key", "least", (F.col("inside") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
        joined = materialise(joined, "nodes")
        least = materialise(joined.groupBy("part").agg(F.min("least").alias("component_id")), "parts")
        classes = materialise(joined.join(least, "part").select("key", "n_links", "component_id"), "classes")
        linked = known.select("id", "key").join(classes, "key").select("id", "n_links", "component_id")
        alone = units.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        found = scratch.keep(linked.unionByName(alone))
    return found.select(F.col("id").alias(id_column), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"))
