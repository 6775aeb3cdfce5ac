"""The entity graph: co-mentions, maintenance, prerequisites, paths and centrality.

Mentions are ``(chunk, key)`` rows and edges ``(src, dst, ...)`` rows. Loops write
their state between rounds and stop on a count; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.config import DAMPING, MERGE_SIMILARITY, MERGE_TOP_K, MIN_COOCCURRENCE, PAGERANK_FALLBACK_ROUNDS, PAGERANK_ROUNDS, PREREQ_THRESHOLD
from loomgraph.functions.vector import unit
from loomgraph.operators.components import connected_components
from loomgraph.operators.nearest import nearest, numbered, with_key, with_number
from loomgraph.storage import dealt_by_rows, discard, in_small_files, materialise, read_by_rows


#: Entities of one chunk that a task pairs with as many others; larger chunks are split.
BLOCK = 1024


def _blocks(rows: DataFrame, sizes: DataFrame, by: str, key: str, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, with columns ``x`` and ``y`` of block numbers: joined on both, each pair of a group meets once.

    A group of more than ``BLOCK`` rows is as many blocks, each sent to all of its group's, so a large group is many tasks.
    ``sizes`` are the rows of each group.
    """
    blocks = sizes.select(by, F.ceil(F.col("__rows") / BLOCK).cast("int").alias("__blocks")).where("__blocks > 1")
    placed = rows.join(materialise(blocks, "sizes"), by, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int"), F.explode(F.expr("sequence(0, __blocks - 1)"))
    return placed.withColumn(x, own).withColumn(y, every).drop("__blocks"), placed.withColumn(y, own).withColumn(x, every).drop("__blocks")


def cooccurrence(mentions: DataFrame, chunk: str = "chunk", key: str = "key", least: int = 1) -> DataFrame:
    """``(src, dst, weight)``, ``src < dst``: in how many chunks two entities stand together.

    Pairs are written: how many there are is known before they are made, and tasks are as many as that needs.
    Tables are read by rows too, so that neither end of a shuffle holds more where there are more mentions, and mentions
    in large row groups, which a task can't read a part of, are first written in smaller ones.
    """
    spark = mentions.sparkSession
    named = mentions.select(chunk, key).where(F.col(chunk).isNotNull() & F.col(key).isNotNull())  # those without either pair with nothing
    rows = named.count()
    with read_by_rows(named, rows):
        small = in_small_files(named, "named")
    with dealt_by_rows(spark, rows), read_by_rows(small, rows):
        once = materialise(small.distinct(), "mentions")
    if small is not named:
        discard(small)
    rows = once.count()
    with dealt_by_rows(spark, rows), read_by_rows(once, rows):
        sizes = materialise(once.groupBy(chunk).agg(F.count("*").alias("__rows")), "groups")
    n = F.col("__rows")
    made, sent = sizes.agg(F.sum(n * (n + 1) / 2).cast("long"), F.sum(n * F.ceil(n / BLOCK))).first()
    with dealt_by_rows(spark, made or 0), read_by_rows(once, sent or 0):
        x, y = _blocks(once, sizes, chunk, key, "__x", "__y")
        on = [chunk, "__x", "__y"]
        pairs = x.withColumnRenamed(key, "src").join(y.withColumnRenamed(key, "dst"), on).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
        return materialise(pairs.where(F.col("weight") >= (least or MIN_COOCCURRENCE)), "pairs")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge once in either direction, other columns kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select(F.col("dst"), F.col("src"), *rest))


def prerequisites(pairs: DataFrame, threshold: float = PREREQ_THRESHOLD, previous: DataFrame | None = None) -> DataFrame:
    """``(src, dst, refd)`` from co-mention pairs: src is a prerequisite of dst.

    The reference distance of A and B is ``(|N(B)| - |N(A)|) / |N(A) union N(B)|``.
    Common neighbours of a pair are the triangles over it. Each triangle is found once,
    from its end of least degree, so a hub does not multiply its neighbours. How many
    wedges are tried is known before they are made, and tasks are as many as that needs.
    """
    spark = pairs.sparkSession
    pairs = materialise(pairs.select("src", "dst").distinct(), "pairs")
    rows = pairs.count()
    with dealt_by_rows(spark, 2 * rows), read_by_rows(pairs, rows):
        degree = materialise(both_ways(pairs).groupBy("src").agg(F.count("*").alias("n")), "degrees")
        ends = pairs.join(degree.withColumnRenamed("n", "ns"), "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("nd")), "dst")
        up = F.struct("ns", "src") < F.struct("nd", "dst")
        rising = materialise(ends.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")), "rising")
        n = F.col("n")
        made = rising.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2).cast("long")).first()[0] or 0
    open_pairs = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    wedges = rising.alias("x").join(rising.alias("y"), "u").where("x.v < y.v").select("u", F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    triangles = wedges.join(open_pairs, ["a", "b"])
    sides = F.explode(F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("a", "b"), ("u", "a"), ("u", "b"))]))
    common = triangles.select(sides.alias("s")).groupBy("s.a", "s.b").agg(F.count("*").alias("common"))
    na, nb = degree.select(F.col("src").alias("a"), F.col("n").alias("na")), degree.select(F.col("src").alias("b"), F.col("n").alias("nb"))
    sized = open_pairs.join(common, ["a", "b"], "left").join(na, "a").join(nb, "b")
    refd = (F.col("nb") - F.col("na")) / (F.col("na") + F.col("nb") - F.coalesce("common", F.lit(0)))
    far = sized.withColumn("refd", refd).where(F.abs("refd") > threshold)
    forward = F.col("refd") > 0
    edges = far.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), F.abs("refd").alias("refd"))
    if previous is not None:
        edges = edges.join(previous.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    with dealt_by_rows(spark, made + rows), read_by_rows(pairs, rows):
        return materialise(edges, "prerequisites")


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """Entities without an edge; documents and chunks never are."""
    used = edges.select(F.col("src").alias(key)).union(edges.select(F.col("dst"))).distinct()
    return nodes.where(~F.col("label").isin("Document", "Chunk")).join(used, key, "left_anti")


def rewrite(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``canonical(key, to)``, parallel ones merged, self loops dropped."""
    for end in ("src", "dst"):
        to = canonical.select(F.col("key").alias(end), F.col("to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    by = [c for c in ("src", "dst", "type") if c in edges.columns]
    return edges.where("src <> dst").groupBy(*by).agg(*[F.max(c).alias(c) for c in rest]) if rest else edges.where("src <> dst").distinct()


def alias_canonical(nodes: DataFrame, resolved: Column) -> DataFrame:
    """``(key, to)`` for nodes that share a label and a resolved slug with another: they become one key."""
    named = nodes.select("key", F.concat_ws(":", F.lower("label"), resolved).alias("to"))
    shared = named.groupBy("to").agg(F.count("*").alias("n")).where("n > 1")
    return named.join(shared, "to", "left_semi").where("key <> to").select("key", "to")


def top_similar(nodes: DataFrame, threshold: float = MERGE_SIMILARITY, k: int = MERGE_TOP_K) -> DataFrame:
    """``(key, other, similarity)``: of each node the ``k`` most similar of its label at or over the threshold.

    Nodes of a label meet as matrix products of blocks; each task cuts to the ``k`` best of a node
    before the shuffle.
    """
    vectors = nodes.where(F.col("embedding").isNotNull() & F.col("label").isNotNull()).select("key", F.col("label").cast("string").alias("label"), unit(F.col("embedding")).alias("vector"))
    vectors = materialise(vectors, "vectors")
    ids = numbered(vectors.select("key"))
    rows = with_number(vectors, "key", ids).select("n", "label", "vector")
    found = nearest(rows, rows, k, least=threshold, cosine=False)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "n"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return with_key(with_key(best, "q", "key", ids), "n", "other", ids).select("key", "other", F.col("score").alias("similarity"))


def embedding_canonical(nodes: DataFrame, threshold: float = MERGE_SIMILARITY, k: int = MERGE_TOP_K) -> DataFrame:
    """``(key, to)`` from components of similar nodes of one label; the least key stays."""
    parts = connected_components(top_similar(nodes, threshold, k), "key", "other")
    return parts.where("node <> component").select(F.col("node").alias("key"), F.col("component").alias("to"))


def merge_entities(nodes: DataFrame, edges: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after merging: merged keys are gone and their edges lead to the key that stays."""
    kept = nodes.join(canonical.select("key"), "key", "left_anti")
    missing = canonical.select(F.col("to").alias("key")).distinct().join(kept.select("key"), "key", "left_anti")
    made = nodes.join(canonical, "key").groupBy("to").agg(F.min(F.struct("key", *[c for c in nodes.columns if c != "key"])).alias("r"))
    made = made.join(missing.withColumnRenamed("key", "to"), "to", "left_semi").select(F.col("to").alias("key"), *[F.col(f"r.{c}") for c in nodes.columns if c != "key"])
    return kept.unionByName(made), rewrite(edges, canonical)


def pagerank(edges: DataFrame, rounds: int = PAGERANK_ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(key, pagerank)``: ``(1 - d) + d * sum(rank / out degree)``, from 1, not normalised."""
    edges = materialise(edges.select("src", "dst"), "edges")
    nodes = materialise(edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct(), "nodes")
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = materialise(edges.join(out, "src"), "links")
    rank = nodes.withColumn("pagerank", F.lit(1.0))
    for i in range(rounds):
        sent = links.join(rank.withColumnRenamed("key", "src"), "src").select(F.col("dst").alias("key"), (F.col("pagerank") / F.col("degree")).alias("got"))
        # Every node gets at least nothing, so no join brings the nodes back.
        rank = sent.unionByName(nodes.withColumn("got", F.lit(0.0))).groupBy("key").agg((1 - damping + damping * F.sum("got")).alias("pagerank"))
        if i % 5 == 4:
            rank = materialise(rank, "rank")
    return rank


def pagerank_weighted(edges: DataFrame, rounds: int = PAGERANK_FALLBACK_ROUNDS, damping: float = DAMPING, tolerance: float = 1e-6) -> DataFrame:
    """``(key, pagerank)`` that sums to 1; weight decides the shares, dangling mass goes to all."""
    edges = materialise(edges.select("src", "dst", "weight"), "edges")
    nodes = materialise(edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = materialise(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    sinks = materialise(nodes.join(out.select(F.col("src").alias("key")), "key", "left_anti"), "sinks")
    rank = materialise(nodes.withColumn("pagerank", F.lit(1.0 / n)), "rank")
    for _ in range(rounds):
        dangling = rank.join(sinks, "key", "left_semi").agg(F.sum("pagerank")).first()[0] or 0.0
        sent = links.join(rank.withColumnRenamed("key", "src"), "src").groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        base = (1 - damping) / n + damping * dangling / n
        new = rank.join(sent, "key", "left").select("key", F.col("pagerank").alias("before"), (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        new = materialise(new, "rank")
        moved = new.agg(F.sum(F.abs(F.col("pagerank") - F.col("before")))).first()[0]
        rank = new.select("key", "pagerank")
        if moved < n * tolerance:
            break
    return rank


def closure(edges: DataFrame, start: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``(key)``: all that leads to ``start(key)`` along edges, the start included; any graph, cycles too."""
    seen = materialise(start.select("key").distinct(), "seen")
    frontier = seen
    for _ in range(max_rounds):
        found = edges.join(frontier.withColumnRenamed("key", "dst"), "dst", "left_semi").select(F.col("src").alias("key")).distinct()
        frontier = materialise(found.join(seen, "key", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = materialise(seen.union(frontier), "seen")
    raise RuntimeError(f"the closure goes on after {max_rounds} rounds")


def learning_path(edges: DataFrame, target, max_rounds: int = 100_000) -> DataFrame:
    """``(key, level, has_cycle)`` of everything the target needs, in order of (level, key).

    Nodes peel off in rounds once all their prerequisites have; ``level`` is the
    round, the longest chain below. What is left lies on or behind a cycle and comes
    last.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(target,)], f"key {edges.schema['src'].dataType.simpleString()}")
    nodes = closure(edges, start)
    inside = edges.select("src", "dst").join(nodes.withColumnRenamed("key", "src"), "src", "left_semi").join(nodes.withColumnRenamed("key", "dst"), "dst", "left_semi")
    inside = materialise(inside.distinct(), "inside")
    left, done = nodes, None
    for level in range(max_rounds):
        blocked = inside.join(left.withColumnRenamed("key", "src"), "src", "left_semi").select(F.col("dst").alias("key")).distinct()
        free = materialise(left.join(blocked, "key", "left_anti").withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            break
        done = free if done is None else materialise(done.union(free), "done")
        left = materialise(left.join(free, "key", "left_anti"), "left")
    else:
        raise RuntimeError(f"the path goes on after {max_rounds} rounds")
    rest = left.withColumn("level", F.lit(None).cast("int"))
    cyclic = not left.isEmpty()
    result = rest if done is None else done.union(rest)
    return result.withColumn("has_cycle", F.lit(cyclic)).orderBy(F.col("level").asc_nulls_last(), "key")


def learning_gaps(studied: DataFrame, prereq: DataFrame, ranks: DataFrame, top: int = 10) -> DataFrame:
    """``(concept_key, dependents, pagerank)``: what studied concepts need and is not studied itself."""
    studied = studied.select("key").distinct()
    wanted = prereq.join(studied.withColumnRenamed("key", "dst"), "dst", "left_semi").join(studied.withColumnRenamed("key", "src"), "src", "left_anti")
    gaps = wanted.groupBy(F.col("src").alias("concept_key")).agg(F.count_distinct("dst").alias("dependents"))
    ranked = gaps.join(ranks.withColumnRenamed("key", "concept_key"), "concept_key", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    return ranked.orderBy(F.desc("dependents"), F.desc("pagerank"), "concept_key").limit(top)


def paths(edges: DataFrame, start: DataFrame, hops: int, carry: Column | None = None) -> DataFrame:
    """``(seed, key, hop, product)`` of undirected paths of 1 to ``hops`` edges, no edge twice in a path.

    ``carry`` is each edge's factor, multiplied along the path.
    """
    factor = (carry if carry is not None else F.lit(1.0)).cast("double")
    name = [c for c in ("src", "dst", "type") if c in edges.columns]  # edges of different types between two nodes are two
    numbered = edges.select("src", "dst", factor.alias("factor"), F.xxhash64(*name).alias("edge"))
    steps = materialise(both_ways(numbered), "steps")
    level = start.select(F.col("key").alias("seed"), "key", F.array().cast("array<bigint>").alias("trail"), F.lit(1.0).alias("product"))
    found = None
    for hop in range(1, hops + 1):
        level = level.join(steps.withColumnRenamed("src", "key"), "key").where(~F.array_contains("trail", F.col("edge")))
        level = level.select("seed", F.col("dst").alias("key"), F.array_append("trail", F.col("edge")).alias("trail"), (F.col("product") * F.col("factor")).alias("product"))
        level = materialise(level, "paths")
        now = level.select("seed", "key", F.lit(hop).alias("hop"), "product")
        found = now if found is None else found.union(now)
    return found


def neighbours(edges: DataFrame, centre, depth: int = 1, limit: int = 50) -> DataFrame:
    """``(key, hops)`` of entities within ``depth`` edges of the centre, nearest first."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(centre,)], f"key {edges.schema['src'].dataType.simpleString()}").withColumn("hops", F.lit(0))
    near = both_ways(edges.select("src", "dst"))
    frontier = seen
    for hop in range(1, depth + 1):
        found = near.join(frontier.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key")).distinct()
        frontier = materialise(found.join(seen, "key", "left_anti").withColumn("hops", F.lit(hop)), "near")
        seen = seen.union(frontier)
    return seen.where("hops > 0").orderBy("hops", "key").limit(limit)


def neighbourhood(nodes: DataFrame, edges: DataFrame, centre, depth: int = 1, limit: int = 50) -> DataFrame:
    """``(key, label, name, pagerank, relationship_type, relationship_weight, hops)`` of what paths from the centre end in.

    Paths have up to ``depth`` edges, either way, none twice; type and weight, 1 where
    there is none, are the last edge's. Documents and chunks are not listed, though paths
    go through them. A node without a label is a Concept and one without a name has its
    key. Nearest first, at most ``limit`` rows; none for a centre that is not there.
    """
    spark = edges.sparkSession
    numbered = edges.select("src", "dst", "type", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), F.xxhash64("src", "dst", "type").alias("edge"))
    steps = materialise(both_ways(numbered), "steps")
    start = spark.createDataFrame([(centre,)], f"key {edges.schema['src'].dataType.simpleString()}").join(nodes.select("key"), "key", "left_semi")
    level, found = start.withColumn("trail", F.array().cast("array<bigint>")), None
    for hop in range(1, depth + 1):
        level = level.join(steps.withColumnRenamed("src", "key"), "key").where(~F.array_contains("trail", F.col("edge")))
        level = materialise(level.select(F.col("dst").alias("key"), F.array_append("trail", F.col("edge")).alias("trail"), "type", "weight"), "level")
        now = level.select("key", F.col("type").alias("relationship_type"), F.col("weight").alias("relationship_weight"), F.lit(hop).alias("hops"))
        found = now if found is None else found.union(now)
        level = level.select("key", "trail")
    found = found.groupBy("key", "relationship_type", "relationship_weight").agg(F.min("hops").alias("hops"))
    named = nodes.select("key", F.coalesce("label", F.lit("Concept")).alias("label"), F.coalesce("name", F.col("key").cast("string")).alias("name"), "pagerank")
    rows = found.join(named.where(~F.col("label").isin("Document", "Chunk")), "key").orderBy("hops", "key", "relationship_type").limit(limit)
    return rows.select("key", "label", "name", "pagerank", "relationship_type", "relationship_weight", "hops").orderBy("hops", "key", "relationship_type")


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges that lie on a cycle: those with both ends in one strongly connected component.

    The greatest key that reaches a node is the same for a whole component, and so is
    the greatest that it reaches; edges between different ones go, in turns of either
    direction, until a turn of each drops none.
    """
    left = materialise(edges, "on_cycles")
    n, steady, back = left.count(), 0, False
    while n and steady < 2:
        src, dst = ("dst", "src") if back else ("src", "dst")
        links = left.select(F.col(src).alias("from"), F.col(dst).alias("to")).distinct()
        best = links.select(F.col("from").alias("key")).union(links.select("to")).distinct().withColumn("best", F.col("key"))
        best = materialise(best, "best")
        while True:
            sent = links.join(best.withColumnRenamed("key", "from"), "from").groupBy(F.col("to").alias("key")).agg(F.max("best").alias("got"))
            new = best.join(sent, "key", "left").select("key", F.greatest("best", "got").alias("best"), (F.col("got") > F.col("best")).alias("moved"))
            new = materialise(new, "best")
            best = new.select("key", "best")
            if new.where("moved").isEmpty():
                break
        x, y = best.select(F.col("key").alias("src"), F.col("best").alias("x")), best.select(F.col("key").alias("dst"), F.col("best").alias("y"))
        left = materialise(left.join(x, "src").join(y, "dst").where("x = y").select(*edges.columns), "on_cycles")
        before, n = n, left.count()
        steady = steady + 1 if n == before else 0
        back = not back
    return left


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """``(cycle, refd, weakest_src, weakest_dst)``: simple cycles, each once, from its least node.

    Paths only go to nodes greater than their first, so every rotation but one is cut
    off at once, and only along edges that lie on a cycle. They go on until none is
    open, or for ``max_length`` edges if given. The weakest edge is that of least ``refd``.
    """
    steps = on_cycles(edges.select("src", "dst", "refd"))
    walk = steps.where("src <= dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("cycle"), F.struct("refd", "src", "dst").alias("weakest"))
    found, length = None, 0
    while max_length is None or length < max_length:
        length += 1
        closed = walk.where("first = last").select("cycle", F.col("weakest.refd").alias("refd"), F.col("weakest.src").alias("weakest_src"), F.col("weakest.dst").alias("weakest_dst"))
        found = closed if found is None else found.union(closed)
        going = walk.where("first <> last").join(steps.withColumnRenamed("src", "last"), "last")
        going = going.where((F.col("dst") >= F.col("first")) & ~F.array_contains(F.slice("cycle", 2, F.size("cycle")), F.col("dst")))
        walk = materialise(going.select("first", F.col("dst").alias("last"), F.array_append("cycle", F.col("dst")).alias("cycle"), F.least("weakest", F.struct(F.col("refd"), F.col("last").alias("src"), F.col("dst"))).alias("weakest")), "walk")
        if walk.isEmpty():
            break
    return found


def break_cycles(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges without the weakest of each cycle."""
    gone = found.select(F.col("weakest_src").alias("src"), F.col("weakest_dst").alias("dst")).distinct()
    return edges.join(gone, ["src", "dst"], "left_anti")


def overview(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: documents, concepts, technologies and edges; all 0 for a user without documents."""
    ids = documents.select("id")
    rows = ids.count()
    with dealt_by_rows(documents.sparkSession, rows), read_by_rows(ids, rows):
        docs = materialise(ids.agg(F.count_distinct("id").alias("documents")), "documents")
    of = nodes.agg(F.count_if(F.col("label") == "Concept").alias("concepts"), F.count_if(F.col("label") == "Technology").alias("technologies"))
    joined = docs.crossJoin(F.broadcast(of)).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    return joined.select("documents", *[F.when(F.col("documents") > 0, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("concepts", "technologies", "edges")])


def maintain(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge, recompute co-occurrence, drop orphans, break cycles, rank: nodes, edges and a row of counts."""
    merged_nodes, merged_edges = merge_entities(nodes, edges, canonical)
    pairs = cooccurrence(mentions.join(canonical, "key", "left").select("chunk", F.coalesce("to", "key").alias("key")))
    fresh = pairs.select("src", "dst", F.lit("CO_OCCURS_WITH").alias("type"), F.col("weight").cast("double"), F.lit(None).cast("double").alias("refd"))
    kept = merged_edges.where("type <> 'CO_OCCURS_WITH'").select("src", "dst", "type", "weight", "refd").unionByName(fresh)
    kept = materialise(kept, "edges")
    lone = materialise(orphans(merged_nodes, kept).select("key"), "orphans")
    prereq = kept.where("type = 'PREREQUISITE_OF'")
    loops = materialise(cycles(prereq), "cycles")
    final = materialise(kept.where("type <> 'PREREQUISITE_OF'").unionByName(break_cycles(prereq, loops).select(*kept.columns)), "edges")
    ranks = pagerank(both_ways(final.where("type = 'CO_OCCURS_WITH'")).select("src", "dst").union(final.where("type <> 'CO_OCCURS_WITH'").select("src", "dst")))
    ranked = merged_nodes.join(lone, "key", "left_anti").drop("pagerank").join(ranks, "key", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    counts = [canonical.agg(F.count("*").alias("merged")), pairs.agg(F.count("*").alias("cooccurrences")), lone.agg(F.count("*").alias("orphans")), loops.agg(F.count("*").alias("cycles"))]
    summary = counts[0]
    for c in counts[1:]:
        summary = summary.crossJoin(F.broadcast(c))  # one row each
    return ranked.select(*nodes.columns), final, summary
