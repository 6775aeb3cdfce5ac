"""Semantic search, spreading activation over the graph, and retrieval evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.config import ACTIVATED_LIMIT, DECAY, GATE, HOPS, SEEDS
from loomgraph.functions.vector import clamp, cosine
from loomgraph.operators.graph import both_ways, paths
from loomgraph.operators.nearest import nearest, numbered, with_key, with_number
from loomgraph.storage import materialise


def semantic_search(vectors: DataFrame, query: list[float], documents: DataFrame, *, user, category=None, k: int = 10) -> DataFrame:
    """The ``k`` chunks of a user nearest to the query vector, best first: an exact scan with a distributed top-k.

    Filters run before any distance; title and preview are joined to the ``k`` hits only.
    The preview is the documents' own column, if they have one. An empty query, that is no
    vector, finds nothing.
    """
    rows = vectors.where(F.col("user_id") == F.lit(user))
    if category is not None:
        rows = rows.where(F.col("category") == F.lit(category))
    if not query:
        rows = rows.where(F.lit(False))
    score = clamp(F.coalesce(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")), F.lit(0.0)))
    hits = rows.select("chunk_id", "document_id", "category", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
    preview = F.col("preview") if "preview" in documents.columns else F.lit("")
    titled = hits.join(documents.select(F.col("id").alias("document_id"), "title", preview.alias("preview")), "document_id", "left").orderBy(F.desc("score"), "chunk_id")
    return titled.select("chunk_id", "document_id", F.coalesce("title", F.lit("Unknown")).alias("document_title"), "score", F.coalesce("preview", F.lit("")).alias("preview"), "category")


def seeds(nodes: DataFrame, query: list[float], k: int = SEEDS) -> DataFrame:
    """``(key, score)``: the ``k`` concepts and technologies nearest to the query, over both labels."""
    able = nodes.where(F.col("label").isin("Concept", "Technology") & F.col("embedding").isNotNull())
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return able.select("key", score.alias("score")).where("score is not null").orderBy(F.desc("score"), F.desc("key")).limit(k)


def activation(nodes: DataFrame, edges: DataFrame, query: list[float], start: DataFrame, *, hops: int = HOPS, decay: float = DECAY, gate: float = GATE, limit: int | None = ACTIVATED_LIMIT) -> DataFrame:
    """``(seed, key, activation)``: over all paths from a seed, the product of ``decay * weight`` times the node's similarity.

    A node counts when its similarity to the query reaches ``gate``; edges without a
    weight weigh 1.
    """
    reached = paths(edges, start, hops, decay * F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    strength = reached.groupBy("seed", "key").agg(F.sum("product").alias("strength"))
    sigma = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    open_nodes = nodes.where(F.col("embedding").isNotNull()).select("key", sigma.alias("sigma")).where(F.col("sigma") >= gate)
    found = strength.join(open_nodes, "key").select("seed", "key", (F.col("strength") * F.col("sigma")).alias("activation"))
    return found if limit is None else found.orderBy(F.desc("activation"), "seed", "key").limit(limit)


def activation_by_reach(nodes: DataFrame, edges: DataFrame, query: list[float], start: DataFrame, *, hops: int = HOPS, decay: float = DECAY, gate: float = GATE, limit: int = ACTIVATED_LIMIT) -> DataFrame:
    """``(key, activation)`` of nodes within ``hops`` of a seed: similarity times ``decay``, whatever the way."""
    near, level = both_ways(edges.select("src", "dst")), start.select("key")
    seen = None
    for _ in range(hops):
        level = materialise(near.join(level.withColumnRenamed("key", "src"), "src", "left_semi").select(F.col("dst").alias("key")).distinct(), "level")
        seen = level if seen is None else seen.union(level)
    sigma = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    able = nodes.where(F.col("embedding").isNotNull()).select("key", sigma.alias("sigma")).where(F.col("sigma") >= gate)
    found = able.join(seen, "key", "left_semi").select("key", (F.col("sigma") * decay).alias("activation"))
    return found.orderBy(F.desc("activation"), "key").limit(limit)


def induced_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Undirected edges with both ends in ``keys``, each once (of each type, where edges have one); no weight is 1, a weight of 0 null."""
    for end in ("src", "dst"):
        edges = edges.join(keys.select(F.col("key").alias(end)).distinct(), end, "left_semi")
    kind = [c for c in ("type",) if c in edges.columns]
    weight = F.nullif(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), F.lit(0.0))
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *kind, weight.alias("weight"))
    return ends.groupBy("src", "dst", *kind).agg(F.max("weight").alias("weight"))


@dataclass(frozen=True)
class Subgraph:
    """What a graph search gives: ranked nodes, the edges between them, the seeds, and whether the graph could not be read."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    degraded: bool = False


def graph_search(
    spark: SparkSession, graph: Callable[[], tuple[DataFrame, DataFrame]], query: list[float], *, k: int = SEEDS, hops: int = HOPS, decay: float = DECAY, gate: float = GATE, limit: int = ACTIVATED_LIMIT
) -> Subgraph:
    """Seeds near the query, activation spread from them, and the edges induced by the activated nodes.

    ``nodes`` are ``(key, label, name, activation, pagerank)``: the activation summed over
    seeds, the ``limit`` highest, best first; ``edges`` are ``(src, dst, type, weight)``.
    ``graph`` loads nodes and edges; where it fails the result is empty and ``degraded``.
    An empty query finds nothing and is not degraded.
    """
    none = (spark.createDataFrame([], x) for x in ("key string, label string, name string, activation double, pagerank double", "src string, dst string, type string, weight double", "key string, score double"))
    try:
        nodes, edges = graph()
    except AnalysisException:
        return Subgraph(*none, degraded=True)
    if not query:
        return Subgraph(*none)
    start = materialise(seeds(nodes, query, k), "seeds")
    spread = activation(nodes, edges, query, start.select("key"), hops=hops, decay=decay, gate=gate, limit=None)
    per = spread.groupBy("key").agg(F.sum("activation").alias("activation")).orderBy(F.desc("activation"), "key").limit(limit)
    named = nodes.select("key", F.coalesce("label", F.lit("Concept")).alias("label"), F.coalesce("name", F.col("key").cast("string")).alias("name"), "pagerank")
    best = materialise(per.join(named, "key").select("key", "label", "name", "activation", "pagerank"), "activated")
    return Subgraph(best.orderBy(F.desc("activation"), "key"), induced_edges(edges, best.select("key")), start)


def evaluate(ranked: DataFrame, query: str, rank: str, relevant: str) -> DataFrame:
    """One row of hit@1/5/10, MRR and nDCG@10 from ``(query, rank, relevant)`` rows, rank from 1."""
    hit = F.col(relevant).cast("int")
    gain = F.when(F.col(rank) <= 10, hit / F.log2(F.col(rank) + 1.0)).otherwise(0.0)
    per = ranked.groupBy(query).agg(
        *[F.max(F.when(F.col(rank) <= k, hit).otherwise(0)).alias(f"h{k}") for k in (1, 5, 10)],
        F.max(F.when(hit == 1, 1 / F.col(rank)).otherwise(0.0)).alias("rr"),
        F.sum(gain).alias("dcg"),
        F.sum(hit).alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), F.col("n").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = per.withColumn("ndcg", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0))
    return per.agg(*[F.avg(f"h{k}").alias(f"hit_at_{k}") for k in (1, 5, 10)], F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg_at_10"))


def macro_f1(judged: DataFrame, wanted: str, got: str) -> DataFrame:
    """One row, ``classification_f1``: the mean over all classes, wanted or got, of the F1 of each."""
    of = judged.select(F.col(wanted).alias("w"), F.col(got).alias("g"))
    ends = of.select(F.explode(F.array(F.struct(F.col("w").alias("c"), F.lit(1).alias("n"), F.lit(0).alias("m")), F.struct(F.col("g").alias("c"), F.lit(0).alias("n"), F.lit(1).alias("m")))).alias("x"), (F.col("w") == F.col("g")).alias("hit"))
    per = ends.groupBy("x.c").agg(F.sum(F.col("x.n") + F.col("x.m")).alias("all"), F.sum(F.when(F.col("hit"), F.col("x.n") + F.col("x.m")).otherwise(0)).alias("right"))
    return per.agg(F.avg(F.col("right") / F.col("all")).alias("classification_f1"))


def ranked_by_cosine(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, id, score, rank)``: for each query the ``k`` nearest of all vectors but its own.

    Scores are cosines rounded to nine places; of equal ones the least id is first, and those that are null are last.
    """
    ids = numbered(vectors.select("id").union(queries.select(F.col("query_id").alias("id"))))
    vector = lambda c: F.col(c).cast("array<double>").alias("vector")
    asked = with_number(queries, "query_id", ids).select("n", F.lit("").alias("label"), vector("query"))
    rows = with_number(vectors, "id", ids).select("n", F.lit("").alias("label"), vector("embedding"))
    found = nearest(asked, rows, k, digits=9).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "n"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return with_key(with_key(best, "q", "query_id", ids), "n", "id", ids).select("query_id", "id", "score", "rank")
