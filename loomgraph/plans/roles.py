"""The fixture tables in the roles of the engine's own: mentions, nodes, edges, documents, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import cooccurrence, prerequisites
from loomgraph.sources.sinks import preview


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mentions(spark: SparkSession, d: str, key: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col(key).alias("key"))


def concept_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d, "l_partkey").distinct()


def technology_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence(_mentions(spark, d, "l_suppkey"))


def concept_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence(_mentions(spark, d, "l_partkey"), least=2)


def concept_prerequisites(spark: SparkSession, d: str) -> DataFrame:
    return prerequisites(concept_pairs(spark, d))


def concept_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as concepts, each with the embedding of ``p_partkey % 500`` and its price for a rank."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("Concept").alias("label"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("pagerank"))
    return parts.join(vectors, F.pmod("key", F.lit(500)) == F.col("__v"), "left").drop("__v")


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Co-mentions of concepts, and their prerequisites."""
    pairs = concept_pairs(spark, d).select("src", "dst", F.lit("CO_OCCURS_WITH").alias("type"), F.col("weight").cast("double").alias("weight"))
    return pairs.union(concept_prerequisites(spark, d).select("src", "dst", F.lit("PREREQUISITE_OF"), F.lit(None).cast("double")))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.pmod("vec_id", F.lit(20)).alias("user_id"), F.col("label").alias("category"), "embedding")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of ``vec_id`` 0, the query of the search examples."""
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an owner (the source) and a made-up age (the id)."""
    rows = table(spark, d, "documents")
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.col("lang").alias("category"), F.substring("text", 1, 40).alias("title"), F.col("doc_id").alias("created_at"), "text", preview(F.col("text")).alias("preview"))


def parsed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as parsed sentences: the first line is the verb, the second its subject and others are objects or not."""
    line = F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("line")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(line)
    orders = lines.groupBy(F.col("l_orderkey").alias("sentence_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))).alias("lines"))

    def token(x: Column, i: Column) -> Column:
        part, supplier = x["line"]["l_partkey"], x["line"]["l_suppkey"]
        objects = F.when(part % 3 == 0, "dobj").when(part % 3 == 1, "pobj").otherwise("advmod")
        return F.struct(
            F.concat(F.lit("Part "), part.cast("string")).alias("text"), x["line"]["l_returnflag"].alias("lemma"),
            F.when(i == 0, "VERB").otherwise("NOUN").alias("pos"), F.when(i == 0, "ROOT").when(i == 1, "nsubj").otherwise(objects).alias("dep"),
            F.lit(0).alias("head"), F.when(supplier % 4 == 0, "PERSON").when(supplier % 4 == 1, "ORG").alias("ent"),
        )

    chunk = F.struct(F.lit(2).alias("first"), F.lit(4).alias("stop"), F.lit(2).alias("root"))
    return orders.select("sentence_id", F.transform("lines", token).alias("tokens"), F.array(chunk).alias("noun_chunks"))


def outbox(spark: SparkSession, d: str) -> DataFrame:
    """Events of the stream as queue events."""
    rows = table(spark, d, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    kinds = F.element_at(F.array(*[F.lit(s) for s in ("document.uploaded", "document.text_ready", "document.chunked", "document.deleted", "document.indexed")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    at = F.col("ts").cast("timestamp")
    return rows.select(
        F.col("event_id").alias("id"), kinds.alias("event_type"), status.alias("status"), F.pmod("event_id", F.lit(6)).cast("int").alias("retry_count"),
        F.lit(5).alias("max_retries"), F.when(status == "PROCESSING", at).alias("locked_at"), F.lit(None).cast("string").alias("error_log"), at.alias("created_at"), "user_id",
    )
