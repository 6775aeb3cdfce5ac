"""Duplicate documents: exact groups, MinHash signatures, banded LSH, verification and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import JACCARD_THRESHOLD, NUM_BANDS, NUM_PERMUTATIONS, SHINGLE_WORDS
from loomgraph.functions.text import plain_tokens
from loomgraph.operators.components import connected_components
from loomgraph.storage import bounded_batches, materialise, tidy

try:  # of one short text after another, without OpenSSL's cost of setting up each
    from _md5 import md5
except ImportError:
    from hashlib import md5

PRIME = (1 << 31) - 1
#: Shingles that are permuted at once.
SLAB = 128


def permutation(i: int) -> tuple[int, int]:
    """The multiplier and the addend of permutation ``i``, by a fixed rule."""
    return (1103515245 * (i + 1) + 12345) % (PRIME - 1) + 1, (22695477 * (i + 1) + 1) % PRIME


def exact_groups(docs: DataFrame, id_column: str, digest: str) -> DataFrame:
    """``(id, representative, members)``; the least id of equal digests represents them."""
    groups = docs.groupBy(digest).agg(F.min(id_column).alias("representative"), F.count("*").alias("members"))
    groups = materialise(groups, "groups")  # so that both sides of the join are shuffled for it and a hot digest can be split
    return docs.join(groups, digest).select(id_column, "representative", "members")


def _least_slots(k: int, permutations: int) -> Callable:
    times, plus = np.array([permutation(i) for i in range(permutations)], dtype=np.uint64).T.copy()
    prime, bits = np.uint64(PRIME), np.uint64(31)

    def permuted(heads: np.ndarray) -> np.ndarray:
        """The least of ``(head * times + plus) % PRIME``: modulo a Mersenne prime, upper bits are added to the lower ones."""
        least, held, other = np.full(permutations, prime), np.empty((SLAB, permutations), np.uint64), np.empty((SLAB, permutations), np.uint64)
        for lo in range(0, len(heads), SLAB):
            some = heads[lo : lo + SLAB, None]
            x, y = held[: len(some)], other[: len(some)]
            np.multiply(some, times, out=x)
            x += plus
            for _ in range(2):
                np.right_shift(x, bits, out=y)
                x &= prime
                x += y
            np.subtract(x, prime, out=y)  # below the prime the difference wraps around
            np.minimum(x, y, out=x)
            np.minimum(least, x.min(axis=0), out=least)
        return least.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = plain_tokens(text or "")
                if len(words) < k:
                    continue
                found = set(map(" ".join, zip(*(words[j:] for j in range(k)), strict=False)))
                # 31 bits of the md5 of each shingle, which any SQL engine can compute too.
                heads = np.frombuffer(b"".join([md5(s).digest()[:4] for s in map(str.encode, found)]), dtype=">u4").astype(np.uint64) % prime
                ids.append(i)
                rows.append(permuted(heads))
            flat = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            starts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * permutations)
            yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.ListArray.from_arrays(starts, flat)], names=[batch.schema.names[0], "signature"])

    return run


def signatures(docs: DataFrame, id_column: str, text: str, k: int = SHINGLE_WORDS, permutations: int = NUM_PERMUTATIONS) -> DataFrame:
    """``(id, signature)`` of documents with at least ``k`` words: the least of each permuted hash.

    One Arrow pass: words are cut and hashed as ``shingles`` has them, and the permutations
    are a matrix in numpy. No row is multiplied by its shingles and nothing is shuffled.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    return docs.select(id_column, text).mapInArrow(tidy(_least_slots(k, permutations)), f"`{id_column}` {kind}, signature array<bigint>")


def band_rows(signed: DataFrame, id_column: str, bands: int = NUM_BANDS) -> DataFrame:
    """``(id, band, key)``, a row for each band of a signature."""
    width = F.size("signature") / bands
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", (i * width).cast("int") + 1, width.cast("int"))).alias("key")))
    return signed.select(id_column, F.explode(parts).alias("x")).select(id_column, "x.*")


def lsh_candidates(signed: DataFrame, id_column: str, bands: int = NUM_BANDS) -> DataFrame:
    """Distinct pairs ``(a, b)``, ``a < b``, that share a band."""
    rows = band_rows(signed, id_column, bands)
    x, y = rows.select("band", "key", F.col(id_column).alias("a")), rows.select("band", "key", F.col(id_column).alias("b"))
    return x.join(y, ["band", "key"]).where("a < b").select("a", "b").distinct()


def estimate(a: Column, b: Column) -> Column:
    """The share of equal signature slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def similar_pairs(signed: DataFrame, id_column: str, threshold: float = JACCARD_THRESHOLD, bands: int = NUM_BANDS) -> DataFrame:
    """Candidates whose estimated Jaccard reaches the threshold."""
    left = signed.select(F.col(id_column).alias("a"), F.col("signature").alias("sa"))
    right = signed.select(F.col(id_column).alias("b"), F.col("signature").alias("sb"))
    pairs = lsh_candidates(signed, id_column, bands).join(left, "a").join(right, "b")
    return pairs.select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def duplicate_clusters(docs: DataFrame, id_column: str, text: str, digest: str, threshold: float = JACCARD_THRESHOLD) -> DataFrame:
    """``(id, representative, members, jaccard)`` of documents in clusters of two or more.

    Equal texts collapse to one document before LSH and equal signatures to one row of
    the bands, so a group of copies costs one signature; clusters are the components of all verified pairs, and ``jaccard``
    is each member's estimate to its representative.
    """
    groups = materialise(docs.groupBy(digest).agg(F.min(id_column).alias("head")), "groups")
    heads = docs.join(groups, F.col(id_column) == F.col("head"), "left_semi")
    signed = materialise(signatures(heads, id_column, text), "signatures")
    # Equal signatures are one for the bands: a group of near copies is a link to its first each.
    firsts = materialise(signed.groupBy("signature").agg(F.min(id_column).alias(id_column), F.count("*").alias("n")), "firsts")
    alike = signed.join(firsts.where("n > 1").select("signature", F.col(id_column).alias("a")), "signature").select("a", F.col(id_column).alias("b")).where("a <> b")
    pairs = similar_pairs(firsts.select(id_column, "signature"), id_column, threshold).select("a", "b")
    pairs = materialise(pairs.union(alike), "pairs")
    parts = connected_components(pairs, "a", "b").select(F.col("node").alias("head"), "component")
    member = docs.select(id_column, digest).join(groups, digest).join(parts, "head", "left")
    member = member.select(id_column, "head", F.coalesce("component", "head").alias("representative"))
    sizes = member.groupBy("representative").agg(F.count("*").alias("members")).where("members > 1")
    own = signed.select(F.col(id_column).alias("head"), F.col("signature").alias("s"))
    other = signed.select(F.col(id_column).alias("representative"), F.col("signature").alias("r"))
    rows = member.join(sizes, "representative").join(own, "head", "left").join(other, "representative", "left")
    jaccard = F.when(F.col("head") == F.col("representative"), F.lit(1.0)).otherwise(estimate(F.col("s"), F.col("r")))
    return rows.select(id_column, "representative", "members", jaccard.alias("jaccard"))


def attach(clusters: DataFrame, links: DataFrame, id_column: str) -> DataFrame:
    """``(id, representative, members)`` after new links ``(a, b)``: clusters ``(id, representative)`` grow, and join where a new document links two."""
    known = clusters.select(F.col(id_column).alias("a"), F.col("representative").alias("b"))
    parts = connected_components(links.select("a", "b").union(known), "a", "b")
    sizes = materialise(parts.groupBy("component").agg(F.count("*").alias("members")), "sizes")
    return parts.join(sizes, "component").select(F.col("node").alias(id_column), F.col("component").alias("representative"), "members")


def links_to(new: DataFrame, known: DataFrame, id_column: str, threshold: float = JACCARD_THRESHOLD, bands: int = NUM_BANDS) -> DataFrame:
    """Similar pairs ``(a, b)`` of signed documents with a ``new`` one in each; ``known`` ones are not compared with each other."""
    signed = new.withColumn("__new", F.lit(True)).unionByName(known.withColumn("__new", F.lit(False)))
    rows = band_rows(signed, id_column, bands).join(signed.select(id_column, "__new"), id_column)
    x, y = rows.where("__new").select("band", "key", F.col(id_column).alias("a")), rows.select("band", "key", F.col(id_column).alias("b"), F.col("__new").alias("n"))
    pairs = x.join(y, ["band", "key"]).where("a <> b and (not n or a < b)").select("a", "b").distinct()
    left, right = (signed.select(F.col(id_column).alias(c), F.col("signature").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(estimate(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")


def duplicate_edges(clusters: DataFrame, id_column: str) -> DataFrame:
    """Edges from each member to its representative."""
    return clusters.where(F.col(id_column) != F.col("representative")).select(F.col(id_column).alias("src"), F.col("representative").alias("dst"), F.lit("DUPLICATE_OF").alias("type"))
