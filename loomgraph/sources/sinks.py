"""Changes of tables as DataFrame algebra: what a store does row by row, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.config import PREVIEW_CHARS


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of each key the row of highest ``version``; a new row wins a tie. Extra columns must match."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete-then-insert: children of each parent in ``new`` are replaced as a whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def conditional_update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set ``columns`` where ``changes`` has a row and a value for the key."""
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*table.columns)


def merge_nodes(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Match or create: an existing node keeps its properties; of new ones with one key any one is created, the least row."""
    fresh = new.join(old.select(key), key, "left_anti")
    rest = [c for c in old.columns if c != key]
    made = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")
    return old.unionByName(made.select(*old.columns))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Match or create by ``(src, dst, type)``: an existing edge keeps its properties; of new parallel ones the least row is created."""
    ends = ["src", "dst", "type"]
    rest = [c for c in old.columns if c not in ends]
    made = new.join(old.select(*ends), ends, "left_anti").groupBy(*ends).agg(F.min(F.struct(*rest, *ends)).alias("__row")).select("__row.*")
    return old.unionByName(made.select(*old.columns))


def with_sidecars(documents: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Documents with their extracted ``text`` of ``(document_id, text)`` rows, and an ``error`` where there is none."""
    found = texts.select(F.col("document_id").alias(key), "text")
    joined = documents.drop("text", "error").join(found, key, "left")
    return joined.withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("no extracted text for "), F.col(key).cast("string"))))


def purge(table: DataFrame, column: str, deleted: DataFrame, deleted_column: str) -> DataFrame:
    """Rows that don't refer to a deleted id; what a cascading delete leaves of a child table."""
    return table.join(deleted.select(F.col(deleted_column).alias(column)).distinct(), column, "left_anti")


def purge_graph(nodes: DataFrame, edges: DataFrame, deleted: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the deleted nodes and all edges at them.

    Keys are sorted and not broadcast: under Spark's threshold in bytes millions of them fit, which each task then counts as its own.
    """
    deleted = deleted.hint("merge")
    left = nodes.join(deleted.select(key), key, "left_anti")
    for end in ("src", "dst"):
        edges = purge(edges, end, deleted, key)
    return left, edges


def rebuild_edges(edges: DataFrame, new: DataFrame, edge_type: str) -> DataFrame:
    """All edges of one type replaced."""
    return edges.where(F.col("type") != edge_type).unionByName(new)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def chunk_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of the vector collection, the category empty where there is none."""
    joined = chunks.join(vectors, "chunk_id")
    return joined.select("chunk_id", "embedding", "document_id", "chunk_index", F.coalesce("category", F.lit("")).alias("category"), "user_id", preview(F.col("text")).alias("preview"))
