"""Semantic chunks, keyphrases and the chain from raw text to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.config import CHUNK_MAX_CHARS, CHUNK_MIN_CHARS, CHUNK_PERCENTILE
from loomgraph.functions.text import clean_text, hard_split, pack, sentences, strip
from loomgraph.functions.vector import Embedder, dot, hashed_vectors
from loomgraph.storage import bounded_batches, tidy


def adjacent_distances(rows: DataFrame, doc: str, order: str, vector: str = "embedding") -> DataFrame:
    """Add ``distance`` of each row's unit vector to the next of its document; null for the last."""
    following = F.lead(vector).over(W.partitionBy(doc).orderBy(order))
    return rows.withColumn("distance", F.when(following.isNotNull(), 1 - dot(F.col(vector), following)))


def boundaries(rows: DataFrame, doc: str, order: str, percentile: float = CHUNK_PERCENTILE) -> DataFrame:
    """Add ``tau``, the document's distance percentile, and ``grp``, the number of boundaries before a row."""
    tau = F.expr(f"percentile(distance, {percentile})").over(W.partitionBy(doc))
    cut = F.coalesce((F.col("distance") > F.col("tau")).cast("int"), F.lit(0))
    before = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("tau", tau).withColumn("grp", F.coalesce(F.sum(cut).over(before), F.lit(0)))


def _sentence_groups(embedder: Embedder, percentile: float = CHUNK_PERCENTILE):
    """Sentences of each document, grouped as ``boundaries`` groups rows, within one Arrow pass."""
    kind = pa.list_(pa.struct([("s", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = []
            for listed in batch.column(1):  # one document's sentences at a time are Python strings
                parts = listed.as_py()
                # Vectors are made 512 sentences at a time, the last one again as the next first.
                far = [np.empty(0)]
                for lo in range(0, len(parts) - 1, 511):
                    v = np.asarray(embedder(parts[lo : lo + 512]), dtype=np.float32).astype(np.float64)
                    far.append(1 - np.einsum("ij,ij->i", v[:-1], v[1:]))
                far = np.concatenate(far)
                ends = np.flatnonzero(far > np.percentile(far, percentile * 100)) + 1 if len(far) else np.empty(0, dtype=int)
                edges = [0, *ends.tolist(), len(parts)]
                groups.append(pa.array([[{"s": parts[a:b]} for a, b in zip(edges, edges[1:], strict=False)]], kind))
            yield pa.record_batch([batch.column(0), pa.concat_arrays([pa.array([], kind), *groups])], names=[batch.schema.names[0], "g"])

    return run


def chunk_documents(docs: DataFrame, doc: str, text: str, *, least: int = CHUNK_MIN_CHARS, most: int = CHUNK_MAX_CHARS, embedder: Embedder = hashed_vectors) -> DataFrame:
    """``(doc, chunk_index, text, char_count)`` of cleaned documents.

    Sentences form groups that end where the distance to the next exceeds the
    document's percentile. A group too short joins the chunk before it, one too long
    is packed from whole sentences; a text of one sentence is split between words.
    """
    cut = docs.select(doc, sentences(clean_text(F.col(text))).alias("s")).where(F.size("s") > 0)
    kind = docs.schema[doc].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    ordered = cut.mapInArrow(tidy(_sentence_groups(embedder)), f"`{doc}` {kind}, g array<struct<s:array<string>>>")

    def step(done, group):
        whole = F.array_join(group["s"], " ")
        last = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), whole)))
        return (
            F.when((F.length(whole) < least) & (F.size(done) > 0), last)
            .when(F.length(whole) > most, F.concat(done, pack(group["s"], most)))
            .otherwise(F.concat(done, F.array(whole)))
        )

    only = F.col("g")[0]["s"][0]
    alone = (F.size("g") == 1) & (F.size(F.col("g")[0]["s"]) == 1)
    chunks = F.when(alone, F.when(F.length(only) > most, hard_split(only, most)).otherwise(F.array(only))).otherwise(
        F.aggregate("g", F.array().cast("array<string>"), step)
    )
    kept = F.filter(F.transform(chunks, strip), lambda c: c != "")
    return ordered.select(doc, F.posexplode(kept).alias("chunk_index", "text")).withColumn("char_count", F.length("text"))


_STOP = frozenset(
    "a an and are as at be been but by can do for from had has have he her his i if in into is it its me my no not of on or our she so that the their them then there these they this to was we were what when which who will with would you your".split()
)


def text_rank(text: str, top: int = 10, window: int = 4, rounds: int = 30) -> list[tuple[str, float, int]]:
    """Phrases between stop words of the whole text, ranked by PageRank of their words in a co-occurrence window."""
    words = text.split()
    plain = {w: w.strip(".,;:!?\"'()[]").lower() for w in set(words)}
    names = sorted({w for w in plain.values() if len(w) > 2 and w not in _STOP})
    if not names:
        return []
    at = {w: i for i, w in enumerate(names)}
    number = {w: at.get(p, -1) for w, p in plain.items()}
    ids = [number[w] for w in words]
    row, n = np.array(ids), len(names)
    steps = [(row[:-d], row[d:]) for d in range(1, window) if len(row) > d]
    near = [(x[both], y[both]) for x, y in steps for both in [(x >= 0) & (y >= 0)]]
    # A pair is one number, so that the numbers' order is that of pairs.
    pairs, weight = np.unique(np.concatenate([np.empty(0, np.int64), *(x * n + y for x, y in near), *(y * n + x for x, y in near)]), return_counts=True)
    start, end = np.divmod(pairs, n)
    weight = weight.astype(np.float64)
    out = np.bincount(start, weights=weight, minlength=n)
    rank, share = np.full(n, 1 / n), out[start]
    for _ in range(rounds if len(pairs) else 0):
        sent = rank[start]
        sent *= weight
        sent /= share
        rank = 0.15 / n + 0.85 * np.bincount(end, weights=sent, minlength=n)
    phrases: dict[tuple[int, ...], int] = {}
    run: tuple[int, ...] = ()
    for i in (*ids, -1):
        if i >= 0 and len(run) < 4:
            run += (i,)
            continue
        if run:
            phrases[run] = phrases.get(run, 0) + 1
        run = (i,) if i >= 0 else ()
    of = rank.tolist()

    def mean(run: tuple[int, ...]) -> float:
        total = 0.0
        for i in run:
            total += of[i]
        return total / len(run)

    best = sorted((-mean(run), " ".join([names[i] for i in run]), times) for run, times in phrases.items())[:top]
    return [(p, round(-r, 6), times) for r, p, times in best]


def keyphrases(chunks: DataFrame, text: str = "text", top: int = 10) -> DataFrame:
    """Add ``keyphrases``, the ``top`` phrases of each row; none where the text is null."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("rank", pa.float64()), ("count", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"text": p, "rank": r, "count": n} for p, r, n in text_rank(t.as_py() or "", top)] for t in batch.column(text)]
            yield pa.record_batch([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "keyphrases"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    bounded_batches(chunks.sparkSession)
    return chunks.mapInArrow(tidy(run), f"{fields}, keyphrases array<struct<text:string,rank:double,count:int>>")
