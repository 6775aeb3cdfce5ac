"""Exact n-gram Jaccard self-join with rare-first prefix, length, positional and suffix filters.

1. Every text becomes a set of word n-grams (64-bit hashes). Texts with equal
   sets collapse to the one of least id; only these representatives are joined.
2. Rare first: a count sketch of fixed size, summed over all texts, orders the
   n-grams globally from rare to frequent (ties by hash). Any order that is the
   same everywhere keeps the join exact; this one keeps hot n-grams out of prefixes.
3. Two texts that reach the threshold share an n-gram in the short prefix of the
   smaller and the longer prefix of the larger. Prefix n-grams that occur once are
   dropped by a bitmap before anything but their hash is shuffled.
4. Lists of texts with a common prefix n-gram are not expanded into pairs. Each
   text first meets one pivot, the list head it shares most n-grams with; verified
   pairs give a first partition. Then only pairs that pass the length and
   positional filters *and lie in different parts* are candidates: in every list
   the members outside its commonest part meet the rest. A pair inside one part
   is linked already, so the components are exact.
5. Each candidate pair is verified once. The suffix filter comes first: the whole sets are
   cut at fixed hashes into ranges, whose sizes bound the overlap, and only pairs that
   may reach the threshold have their sets fetched; there the cuts go on at medians,
   and what is left is told by the true overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import NAMELESS, key_bitmap, node, with_membership, without_ids
from loomgraph.llm.lexing import owners, rolling, slabs, spans_hash, tidy
from loomgraph.llm.repeats import numbered_texts, texts_with
from loomgraph.operators.components import connected_components
from loomgraph.storage import Scratch, discard, materialise, release

SKETCH_BITS = 21
_BLOCK = 4096
_FAN_IN = 64
TOKEN_BITS = 1 << 26
RANGES = 16


def ngram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slab its first row, the distinct n-gram hashes sorted within each text, and where each text's begin."""
    for slab in slabs(texts):
        words, begins = slab.words(lower=True)
        sizes = np.diff(begins)
        grams = rolling(words, n)
        text = owners(begins, len(words))
        inside = np.flatnonzero(np.arange(len(grams)) + n <= begins[1:][text[: len(grams)]]) if len(grams) else np.empty(0, dtype=np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        rows = np.concatenate([text[inside], short])
        hashes = np.concatenate([grams[inside], spans_hash(words, begins[short], begins[short + 1])])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
        yield slab.first, hashes, np.searchsorted(rows, np.arange(len(sizes) + 1))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profile(n: int) -> Callable:
    """Of each text: the size of its set, a 128-bit key of it and its sizes by hash range; and this partition's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["id", "n", "key", "ranges", "block", "counts"]
        kind = pa.list_(pa.int32())
        for batch in batches:
            sizes, keys, ranges = [], [], []
            for _, hashes, begins in ngram_sets(batch.column("text"), n):
                np.add.at(counts, _bucket(hashes), 1)
                sums = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
                np.cumsum(hashes, out=sums[0, 1:])
                np.cumsum(hashes * hashes * np.uint64(0x9E3779B97F4A7C15), out=sums[1, 1:])
                part = (sums[:, begins[1:]] - sums[:, begins[:-1]]).T.copy()
                sizes.append(np.diff(begins))
                keys += [part[i].tobytes() for i in range(len(part))]
                slot = owners(begins, len(hashes)) * RANGES + (hashes >> np.uint64(60)).astype(np.int64)
                ranges.append(np.bincount(slot, minlength=RANGES * len(part)).astype(np.int32))
            if sizes:
                rows = batch.num_rows
                ranges = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * RANGES), pa.array(np.concatenate(ranges)))
                yield pa.record_batch([batch.column("id"), pa.array(np.concatenate(sizes)), pa.array(keys, pa.binary()), ranges, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        blocks = counts.astype(np.uint32).reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        none = pa.nulls(len(used), pa.int64())
        yield pa.record_batch([none, none, pa.nulls(len(used), pa.binary()), pa.nulls(len(used), kind), pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=names)

    return tidy(run)


def _add_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, dtype=np.uint64)
    for value in table.column("counts"):
        total += np.frombuffer(value.as_buffer(), dtype=np.uint32)
    total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([table.column("part")[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(blocks: DataFrame, parts: int) -> np.ndarray:
    """The summed sketch, 4 bytes a bucket: added up by trees of bounded groups, so no task sees more than 64 blocks of 16 KB."""
    while True:
        parts = -(-parts // _FAN_IN)
        blocks = blocks.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("block", "part").applyInArrow(_add_blocks, "block int, part long, counts binary")
        if parts == 1:
            break
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for row in blocks.toLocalIterator():
        sketch[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, dtype=np.uint32)
    return sketch


def _prefixes(n: int, percent: int, sketch, whole: bool) -> Callable:
    """Prefix n-grams of each text: the hashes alone, or with id, set size, place and whether a smaller text must show it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sketch.value
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for first, hashes, begins in ngram_sets(batch.column("text"), n):
                sizes = np.diff(begins)
                text = owners(begins, len(hashes))
                order = np.lexsort((hashes, rank[_bucket(hashes)], text))
                place = np.arange(len(hashes)) - begins[text]
                size = sizes[text]
                keep = place <= size + (-percent * size) // 100
                token, row, place, size = hashes[order][keep], text[keep], place[keep], size[keep]
                if not whole:
                    token, times = np.unique(token, return_counts=True)
                    yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(times)], names=["token", "n"])
                    continue
                short = place <= size + (-2 * percent * size) // (100 + percent)
                yield pa.record_batch(
                    [pa.array(token.view(np.int64)), pa.array(ids[first + row]), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(short)],
                    names=["token", "id", "size", "place", "short"],
                )

    return tidy(run)


def _sets(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, begins in ngram_sets(batch.column("text"), n):
                rows = len(begins) - 1
                yield pa.record_batch([batch.column("id").slice(first, rows), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["id", "grams"])

    return tidy(run)


def suffix_bound(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """Whether sorted ``a`` and ``b`` may share ``need`` items: both are cut at the median of ``b``, again and again."""

    def most(a: np.ndarray, b: np.ndarray, depth: int) -> int:
        if depth == 0 or len(a) < 4 or len(b) < 4:
            return min(len(a), len(b))
        half = len(b) // 2
        cut = int(np.searchsorted(a, b[half]))
        return most(a[:cut], b[:half], depth - 1) + most(a[cut:], b[half:], depth - 1)

    return most(a, b, depth) >= need


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                x, y = (s.values.to_numpy(zero_copy_only=False).view(np.uint64) for s in (a, b))
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                same = len(x) + len(y) - len(np.union1d(x, y)) if suffix_bound(x, y, need) else 0
                linked.append(same >= need)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return tidy(run)


def _verified(pairs: DataFrame, texts: DataFrame, sized: DataFrame, n: int, percent: int) -> DataFrame:
    """``(a, b, linked)`` of distinct pairs ``(a, b)``; those that the ranges rule out are not linked."""
    for end in ("a", "b"):
        pairs = pairs.join(sized.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("ranges").alias(f"ranges_{end}")), end)
    most = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    may = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = materialise(pairs.select("a", "b", may.alias("may")).distinct(), "pairs")
    tried = pairs.where("may").select("a", "b")
    ids = materialise(tried.select(F.col("a").alias("id")).union(tried.select(F.col("b"))).distinct(), "ids")
    sets = materialise(texts_with(texts, ids).select("id", "text").mapInArrow(_sets(n), "id long, grams array<long>"), "sets")
    left = tried.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    done = both.select("a", "b", "grams_a", "grams_b").mapInArrow(_verify(percent), "a long, b long, linked boolean")
    done = materialise(done.unionByName(pairs.where("not may").select("a", "b", F.lit(False).alias("linked"))), "verified")
    discard(sets, ids, pairs)
    release(texts.sparkSession)
    return done


def _may_link(x: str, y: str, percent: int) -> str:
    """The length and the positional filter between rows named ``x`` and ``y`` of one list."""
    return (
        f"100 * least({x}.size, {y}.size) >= {percent} * greatest({x}.size, {y}.size) AND "
        f"{100 + percent} * least({x}.size - {x}.place, {y}.size - {y}.place) >= {percent} * ({x}.size + {y}.size)"
    )


def _classes(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(id, n, component)`` of the rows of ``numbered_texts``, its tables written."""
    spark = texts.sparkSession
    profile = texts.mapInArrow(_profile(words), "id long, n long, key binary, ranges array<int>, block int, counts binary")
    profile = materialise(profile.withColumn("part", F.spark_partition_id().cast("long")), "profile")
    parts = profile.agg(F.max("part")).first()[0]
    sketch = spark.sparkContext.broadcast(_sketch(profile.where("block is not null").select("block", "part", "counts"), (parts or 0) + 1))
    sized = materialise(profile.where("block is null").select("id", "n", "key", "ranges"), "sized")
    discard(profile)
    classes = materialise(sized.where("n > 0").groupBy("key", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    copied = classes.where("copies > 1")
    others = sized.join(copied, ["key", "n"]).where("id <> rep").select("id").distinct()
    # An id with several texts may stand for one class and be a copy in another: then it is read.
    others = materialise(others.join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), "copies")
    heads = without_ids(texts, "id", others)

    counts = heads.select("id", "text").mapInArrow(_prefixes(words, percent, sketch, False), "token long, n long")
    shared = materialise(key_bitmap(counts.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1"), ["token"], TOKEN_BITS), "tokens")
    release(spark)
    lists = heads.select("id", "text").mapInArrow(_prefixes(words, percent, sketch, True), "token long, id long, size int, place int, short boolean")
    lists = materialise(with_membership(lists, ["token"], shared, "__lg_maybe", TOKEN_BITS).where("__lg_maybe").drop("__lg_maybe"), "lists")
    sketch.destroy()
    discard(shared, others)

    # One pivot for each text: the list head that it shares most of its lists with.
    pivots = materialise(lists.groupBy("token").agg(F.min(F.struct("id", "size", "place")).alias("p"), F.count("*").alias("m")).where("m > 1").select("token", "p.*"), "pivots")
    met = lists.alias("x").join(pivots.alias("y"), "token").where(f"x.id <> y.id AND {_may_link('x', 'y', percent)}")
    votes = met.groupBy(F.col("x.id").alias("b"), F.col("y.id").alias("a")).agg(F.count("*").alias("votes"))
    pairs = votes.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b")
    first = _verified(pairs, texts, sized, words, percent)
    parted = materialise(connected_components(first.where("linked"), "a", "b"), "parts")

    # What is left: pairs of one list in different parts.
    placed = lists.join(parted.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    placed = materialise(placed, "placed")
    discard(lists, pivots, parted)
    by_part = placed.groupBy("token", "part").agg(F.count("*").alias("m"))
    common = materialise(by_part.groupBy("token").agg(F.max_by("part", F.struct("m", "part")).alias("common"), F.count("*").alias("parts")).where("parts > 1").drop("parts"), "common")
    mixed = materialise(placed.join(common, "token"), "mixed")
    discard(placed, common)
    outside = mixed.where("part <> common")
    # Of the two, the smaller text shows the n-gram in its short prefix; pairs outside the common part meet once.
    apart = (
        f"x.part <> y.part AND (y.part = y.common OR x.id < y.id) AND {_may_link('x', 'y', percent)} AND "
        "CASE WHEN struct(x.size, x.id) < struct(y.size, y.id) THEN x.short ELSE y.short END"
    )
    rest = outside.alias("x").join(mixed.alias("y"), "token").where(apart)
    rest = rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _verified(rest.join(tried, ["a", "b"], "left_anti"), texts, sized, words, percent)
    links = first.where("linked").select("a", "b").union(second.where("linked").select("a", "b"))
    final = materialise(connected_components(links, "a", "b"), "components").select(F.col("node").alias("rep"), "component")

    known = sized.select("id", "n", "key").join(classes.select("key", "n", "rep"), ["key", "n"], "left").withColumn("rep", F.coalesce("rep", "id"))
    return known.join(final, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = 4, percent: int = 85) -> DataFrame:
    """Return ``(id, n_shingles, component_id)``, a row for each row of ``docs``.

    Words are runs without ASCII blanks, A-Z in lower case; a text's set holds its
    distinct runs of ``words`` words, or its whole sequence as one where it has
    fewer. Texts link when ``100 * intersection >= percent * union``; the
    component is the least id reachable. Null, empty and blank texts have an empty
    set and link with nothing. Rows that repeat an id are one document. Rows without an
    id are documents told apart by their texts, after all others; the component is null
    where none of its documents has an id. Other columns are ignored. Ids are integers
    under 2**62. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.keep(_classes(numbered_texts(docs, id_column, text_column), words, percent))
    real = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    return found.select(real("id").alias(id_column), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def keep_component_heads(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all but one document of each component; all columns as they were.

    The document of least id stays, one without an id only where no other has one; all
    rows that repeat its id stay with it, and one of rows without an id that repeat a text.
    """
    texts = numbered_texts(docs, id_column, text_column)
    with Scratch(docs.sparkSession) as scratch:
        found = _classes(texts, words, percent)
        gone = scratch.keep(materialise(found.where("id <> component").select(F.col("id").alias("__lg_node")).distinct(), "near-copies"))
    left = without_ids(docs.withColumn("__lg_node", node(id_column, text_column)), "__lg_node", gone)
    nameless = left.where(F.col("__lg_node") >= NAMELESS).dropDuplicates(["__lg_node"])
    return left.where(F.col("__lg_node") < NAMELESS).unionByName(nameless).select(*docs.columns)
