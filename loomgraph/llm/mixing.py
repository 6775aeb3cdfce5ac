"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame operations only.

1. Sizes in words are counted in one scan and written as narrow rows.
2. Targets: every source asks for its weight's share of all words and is capped
   at ``max_epochs`` times its own size; what the caps free is shared again by
   weight. The fixed point is ``min(cap, level * weight)``; sources sorted by
   cap/weight give the level in closed form, so no loop is needed.
3. Quotas: a source's target is cut into blocks of equal tokens. Blocks go to
   sources, then down a tree of shards, by highest Sainte-Lague quotients: the
   natural divisor gives all but a few blocks at once, and only the quotients
   around it are ranked. Each node has at most ``fan_out`` children, so no sort
   ever holds the shards of a whole source, and the seats of a node always sum.
4. Selection: inside a shard documents are put in an order seeded by a hash of
   their id, their words are laid end to end, and the first ``quota`` blocks of
   that circular line are taken. A shard is cut to ``shard_words`` and ``shard_rows``
   whatever the size of its source, so a source with a third of all rows is many
   shards, of blank texts too.

Sources are ranked in one task, a row for each; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import node
from loomgraph.storage import Scratch, materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _digit(salt: str, of: Column, start: int) -> Column:
    """Eight hex digits of a seeded md5, as a long; the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), of.cast("string"))), start, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``(source, source_no, source_size, source_rows, weight, target)``, one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    ranked = per.withColumn("source_no", F.row_number().over(by_name)).withColumn(
        "weight", F.get(cycle, F.pmod(F.col("source_no") - 1, F.lit(len(weights))))
    )
    fill = W.orderBy((F.col("source_size") * max_epochs / F.col("weight")).asc(), "source_no")
    before, everything = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = ranked.select(
        "*",
        F.row_number().over(fill).alias("_row"),
        (F.sum("source_size").over(everything) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    )
    # A source is capped when its share of what the sources before it leave reaches its cap;
    # the first that isn't sets the level for itself and all after it.
    open_here = F.col("_words") * F.col("weight") < max_epochs * F.col("source_size") * F.col("_weights")
    at = level.withColumn("_open", F.min(F.when(open_here, F.col("_row"))).over(everything))
    for name, of in (("_w", "_words"), ("_v", "_weights")):
        at = at.withColumn(name, F.max(F.when(F.col("_row") == F.col("_open"), F.col(of))).over(everything))
    target = F.when(F.col("_open").isNull() | (F.col("_row") < F.col("_open")), (max_epochs * F.col("source_size")).cast("double")).otherwise(
        F.col("_w").cast("double") * F.col("weight").cast("double") / F.col("_v").cast("double")
    )
    return at.select("source", "source_no", "source_size", "source_rows", "weight", target.alias("target"))


def apportion(children: DataFrame, parent: list[str], order: list[str], claim: str, seats: str, out: str) -> DataFrame:
    """Split each parent's ``seats`` over its children by Sainte-Lague on ``claim``; adds ``out``.

    ``children`` has the parent's seats on every row. The natural divisor
    ``sum(claim) / seats`` rounds each claim to the nearest whole; the few seats
    then over or missing are those with the lowest or highest quotients
    ``claim / (2k + 1)``. A child can gain or lose at most its share of half the
    number of children, plus one, so about two quotients a child are ranked. Ties
    go to the child first in ``order``. Children that claim nothing get nothing.
    """
    node, ids = W.partitionBy(*parent), [*parent, *order]
    exact = F.col(claim).cast("double") * F.col(seats) / F.col("_all")
    first = (
        children.withColumn("_all", F.sum(claim).over(node).cast("double"))
        .withColumn("_near", F.when(F.col("_all") > 0, F.floor(exact + 0.5)).otherwise(0).cast("long"))
        .withColumn("_short", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_near").over(node)).otherwise(0))
        .withColumn("_reach", F.when(F.col("_all") > 0, F.ceil(F.col(claim) / F.col("_all") * F.abs("_short"))).otherwise(0).cast("int") + 1)
    )
    steps = first.where((F.col("_short") != 0) & (F.col(claim) > 0)).withColumn("_k", F.explode(F.expr("sequence(1, _reach)")))
    gain = F.col(claim) / (2 * (F.col("_near") + F.col("_k")) - 1)
    loss = F.col(claim) / (2 * (F.col("_near") - F.col("_k")) + 1)
    steps = steps.withColumn("_quotient", F.when(F.col("_short") > 0, -gain).otherwise(F.when(F.col("_k") <= F.col("_near"), loss)))
    steps = steps.where("_quotient is not null").withColumn("_rank", F.row_number().over(W.partitionBy(*parent).orderBy("_quotient", *order, "_k")))
    moved = steps.where(F.col("_rank") <= F.abs("_short")).groupBy(*ids).agg(F.sum(F.signum("_short")).cast("long").alias("_moved"))
    fixed = first.join(moved, ids, "left").withColumn(out, F.col("_near") + F.coalesce("_moved", F.lit(0)))
    return fixed.drop("_all", "_near", "_short", "_reach", "_moved")


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    block_words: int = 16,
    shard_words: int = 16384,
    shard_rows: int = 16384,
    fan_out: int = 64,
    seed: str = "mix",
) -> DataFrame:
    """Return ``(id, source, size, source_size, target, taken, shard, quota)``, a row for each row of ``docs``.

    ``weights`` repeat over the sources in code point order, null last. A null
    text has size 0. ``taken`` counts words, repeats included, and is at most
    ``max_epochs * size``. A row without an id is placed by its text. Equal inputs give equal results in any partitioning;
    rows that repeat an id tie, and then the longer one comes first. Other columns
    are ignored. An empty table gives an empty result.
    """
    key = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text:"), F.md5(F.col(text_column))), F.lit("text:"))
    sizes = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(text_column).alias("size"),
        _digit(f"{seed}-shard:", key, 1).alias("_u"), F.md5(F.concat(F.lit(f"{seed}-order:"), key)).alias("_order"),
    )
    sizes = materialise(sizes, "sizes")
    sources = source_targets(sizes, weights, max_epochs).withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows)).cast("long")
    )
    sources = sources.withColumn("_total", F.sum("source_size").over(W.partitionBy()))
    sources = sources.withColumn("_blocks", F.floor(F.col("_total") / block_words + 0.5).cast("long")).withColumn("_one", F.lit(1))
    sources = materialise(apportion(sources, ["_one"], ["source_no"], "target", "_blocks", "seats"), "sources")
    facts = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "shards", "seats")
    placed = sizes.join(facts, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "shard", F.shiftright(F.col("_u") * F.col("shards"), 32)
    )

    # Words of every node of the shard tree, leaves first; then seats from the roots down.
    depth, most = 1, sources.agg(F.max("shards")).first()[0] or 1
    while most > fan_out**depth:
        depth += 1
    leaves = materialise(placed.groupBy("source_no", "shard", "seats").agg(F.sum("size").alias("words")), "shards")
    seats = sources.select("source_no", F.lit(0).cast("long").alias("parent"), "seats")
    for height in range(depth - 1, -1, -1):
        width, above = fan_out**height, fan_out ** (height + 1)
        nodes = leaves.groupBy("source_no", F.floor(F.col("shard") / width).cast("long").alias("node")).agg(F.sum("words").alias("words"))
        nodes = nodes.withColumn("parent", F.floor(F.col("node") * width / above).cast("long"))
        quotas = apportion(nodes.join(seats, ["source_no", "parent"]), ["source_no", "parent"], ["node"], "words", "seats", "quota")
        seats = quotas.select("source_no", F.col("node").alias("parent"), F.col("quota").alias("seats"))
    quotas = materialise(quotas.select("source_no", F.col("node").alias("shard"), "words", "quota"), "quotas")

    seeded = W.partitionBy("source_no", "shard").orderBy("_order", "id", F.desc("size"))
    line = placed.withColumn("_end", F.sum("size").over(seeded.rowsBetween(W.unboundedPreceding, 0))).drop("seats")
    line = line.join(quotas, ["source_no", "shard"]).withColumn("_take", F.least(F.col("quota") * block_words, max_epochs * F.col("words")))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("_take") / F.col("words"))).otherwise(0).cast("long")
    rest = F.col("_take") - F.col("_rounds") * F.col("words")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_rest")) - (F.col("_end") - F.col("size")))
    line = line.withColumn("_rounds", rounds).withColumn("_rest", rest).withColumn("taken", (F.col("_rounds") * F.col("size") + part).cast("long"))
    return line.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", "taken", "shard", "quota")


def repeat_by_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes its words, to the nearest whole number; all columns as they were.

    Rows without words come once. Repeats of a row stand next to each other. Rows are
    told apart by id and number of words, those without an id by their text. Texts
    move once, in a shuffle join that is the same at every size.
    """
    keyed = docs.withColumn("__lg_node", node(id_column, text_column)).withColumn("__lg_size", word_count(text_column))
    with Scratch(docs.sparkSession) as scratch:
        mixed = mix_sources(keyed, "__lg_node", text_column, source_column, **options)
        times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
        times = mixed.groupBy(F.col("__lg_node"), F.col("size").alias("__lg_size")).agg(F.max(times).alias("__lg_times")).where("__lg_times > 0")
        times = scratch.keep(materialise(times, "times"))
    joined = keyed.join(times.hint("shuffle_hash"), ["__lg_node", "__lg_size"])
    return joined.withColumn("__lg_time", F.explode(F.sequence(F.lit(1), F.col("__lg_times")))).select(*docs.columns)
