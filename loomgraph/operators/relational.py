"""Filters, paging, counts and samples over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.config import REPLAY_CAPACITY, REPLAY_SAMPLE
from loomgraph.schemas import OUTBOX_STATUS


def list_documents(docs: DataFrame, user_id, *, status: str | None = None, category: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """One page of a user's documents, newest first, and the ``total`` that match."""
    rows = docs.where(F.col("user_id") == F.lit(user_id))
    for column, value in (("status", status), ("category", category)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    total = rows.agg(F.count("*").alias("total"))
    found = rows.orderBy(F.desc("created_at"), "id").offset((page - 1) * size).limit(size)
    return found.crossJoin(F.broadcast(total))  # the total is one row


def get_document(docs: DataFrame, user_id, document_id) -> DataFrame:
    """The one row of a user's document; none for what another owns."""
    return docs.where((F.col("user_id") == F.lit(user_id)) & (F.col("id") == F.lit(document_id)))


def status_counts(events: DataFrame) -> DataFrame:
    """Number of queue events by status but the completed; 0 where there is none."""
    wanted = [s for s in OUTBOX_STATUS if s != "COMPLETED"]
    counts = [F.count_if(F.col("status") == s).alias(s) for s in wanted]
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in wanted]))
    return events.agg(*counts).select(pairs.alias("x")).select("x.*")


def replay_buffer(items: DataFrame, capacity: int = REPLAY_CAPACITY) -> DataFrame:
    """The newest ``capacity`` items: the buffer is a top-k, oldest items leave."""
    return items.orderBy(F.desc("created_at"), F.desc("id")).limit(capacity)


def replay_sample(items: DataFrame, k: int = REPLAY_SAMPLE, seed: int = 0) -> DataFrame:
    """``k`` items by a seeded hash of their id: random, and the same on every run."""
    return items.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(k)


def class_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (classes * count)`` by class."""
    counts = samples.groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy()  # one row for each class
    return counts.select(label, (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"))


def joined_texts(parts: DataFrame, by: str, order: str, text: str, sep: str = " ") -> DataFrame:
    """Texts of each group in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return parts.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r[text]), sep).alias("text"), F.count("*").alias("n_parts"))
