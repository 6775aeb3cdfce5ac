"""Queue events and the states of documents: emitting, claiming, retry, routing, completion; and the same as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import CLAIM_BATCH, DONE, MAX_ERROR_CHARS, MAX_RETRIES, ROUTES, STUCK_MINUTES
from loomgraph.schemas import DOCUMENT_STATUS
from loomgraph.storage import shared_dir


def claim(events: DataFrame, size: int = CLAIM_BATCH) -> DataFrame:
    """The oldest pending events."""
    return events.where("status = 'PENDING'").orderBy("created_at", "id").limit(size)


def mark_claimed(events: DataFrame, now: Column, size: int = CLAIM_BATCH) -> DataFrame:
    """The queue after a claim: the oldest pending events are in processing, locked from ``now``."""
    taken = claim(events, size).select("id", F.lit(True).alias("__taken"))
    marked = events.join(taken, "id", "left")
    after = {"status": F.when(F.col("__taken"), "PROCESSING").otherwise(F.col("status")), "locked_at": F.when(F.col("__taken"), now.cast("timestamp")).otherwise(F.col("locked_at"))}
    return marked.withColumns(after).drop("__taken").select(*events.columns)


def emit(documents: DataFrame, event_type: str, now: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """A pending event for each row ``(document_id, user_id)``, its id a hash of type and document: emitted twice it is one event."""
    key = F.substring(F.sha2(F.concat_ws(":", F.lit(event_type), F.col("document_id").cast("string")), 256), 1, 32)
    ids = [F.col(c).cast("string").alias(c) for c in ("document_id", "user_id")]
    return documents.select(
        key.alias("id"), F.lit(event_type).alias("event_type"), F.struct(*ids).alias("payload"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"),
        F.lit(max_retries).alias("max_retries"), F.lit(None).cast("timestamp").alias("locked_at"), F.lit(None).cast("string").alias("error_log"), now.cast("timestamp").alias("created_at"), now.cast("timestamp").alias("updated_at"),
    ).dropDuplicates(["id"])


def complete(events: DataFrame, done: DataFrame) -> DataFrame:
    """The queue after tasks: events in ``done(id)`` are completed, and so are those that start no task."""
    final = [e for e, tasks in ROUTES.items() if not tasks]
    marked = events.join(done.select("id", F.lit(True).alias("__done")).distinct(), "id", "left")
    over = F.col("__done") | (F.col("event_type").isin(final) & (F.col("status") == "PROCESSING"))
    return marked.withColumn("status", F.when(over, "COMPLETED").otherwise(F.col("status"))).select(*events.columns)


def settle(attempts: DataFrame, now: Column, most: int = MAX_RETRIES) -> DataFrame:
    """``(event, task)`` attempts with ``retries`` and ``error`` (null if it went well): add ``status`` and ``due``.

    A failure is tried again after ``2 ** retries`` seconds, until ``most`` retries are spent.
    """
    failed, left = F.col("error").isNotNull(), F.col("retries") < most
    wait = F.make_dt_interval(secs=F.pow(F.lit(2), F.col("retries")).cast("decimal(18,6)"))
    status = F.when(~failed, "COMPLETED").when(left, "PENDING").otherwise("FAILED")
    return attempts.withColumn("status", status).withColumn("due", F.when(failed & left, now.cast("timestamp") + wait))


def advance(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents after tasks: each takes the state of the furthest task that went well, or FAILED with the error of one that didn't.

    ``outcomes`` are ``(document_id, task, error, chars)``; ``chars`` is what was extracted.
    A state never goes back; a failed document stays failed until a task goes well.
    """
    steps = F.create_map(*[F.lit(x) for pair in DONE.items() for x in pair])
    order = F.array(*[F.lit(s) for s in DOCUMENT_STATUS if s != "FAILED"])
    reached = F.array_position(order, F.when(F.col("error").isNull(), F.try_element_at(steps, F.col("task"))))
    per = outcomes.groupBy(F.col("document_id").alias("id")).agg(
        F.max(reached).alias("__reached"), F.min("error").alias("__error"), F.max(F.when(F.col("error").isNull(), F.col("chars"))).alias("__chars")
    )
    joined = documents.join(per, "id", "left")
    now = F.greatest(F.array_position(order, F.col("status")), F.coalesce("__reached", F.lit(0)))
    state = F.when(F.col("__error").isNotNull(), "FAILED").when(now > 0, F.try_element_at(order, now.cast("int"))).otherwise(F.col("status"))
    after = {
        "status": state,
        "error_log": F.coalesce(F.substring("__error", 1, MAX_ERROR_CHARS), F.when(F.col("__reached").isNull(), F.col("error_log"))),
        "extracted_chars": F.coalesce(F.col("__chars").cast("int"), "extracted_chars"),
    }
    return joined.withColumns(after).select(*documents.columns)


def reclaim(events: DataFrame, now: Column, minutes: int = STUCK_MINUTES) -> DataFrame:
    """Events stuck in processing become pending again."""
    stuck = F.coalesce((F.col("status") == "PROCESSING") & (F.col("locked_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")), F.lit(False))
    return events.withColumns({"status": F.when(stuck, "PENDING").otherwise(F.col("status")), "locked_at": F.when(~stuck, F.col("locked_at"))})


def retry(events: DataFrame, error: Column) -> DataFrame:
    """Events after a failure: one more try, or failed for good."""
    spent = F.col("retry_count") + 1 >= F.col("max_retries")
    after = {
        "status": F.when(spent, "FAILED").otherwise("PENDING"),
        "retry_count": F.col("retry_count") + 1,
        "locked_at": F.lit(None).cast("timestamp"),
        "error_log": F.substring(error, 1, MAX_ERROR_CHARS),
    }
    return events.withColumns(after)


def route(events: DataFrame, routes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A row for each event and task it starts; none for final events."""
    routes = ROUTES if routes is None else routes
    pairs = [x for e, tasks in routes.items() for x in (F.lit(e), F.array(*[F.lit(t) for t in tasks]).cast("array<string>"))]
    tasks = F.try_element_at(F.create_map(*pairs), F.col("event_type"))
    return events.withColumn("task", F.explode(F.coalesce(tasks, F.array().cast("array<string>"))))


def latest_status(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """The last status of each document."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias(status))


def dispatch_stream(source: DataFrame, handle: Callable[[DataFrame, int], None], name: str, *, every: str | None = None):
    """Run ``handle`` on each micro-batch of routed events; the checkpoint takes the place of row locks.

    Without ``every`` all that is there is processed and the query ends.
    """
    writer = route(source).writeStream.foreachBatch(handle).option("checkpointLocation", f"{shared_dir(source.sparkSession)}/streams/{name}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, at: str, width: str, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Event-time counts by tumbling window; on a stream, state older than ``late`` is dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = timed.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: runs of events closer than ``gap``."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    found = timed.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), "n")
