"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

1. A first scan counts texts by normalised length. A length that occurs once is
   settled: its text has no copy.
2. The lengths that occur again go into a bitmap of fixed size. A second scan hashes
   a prefix of texts of these lengths and of no others, and counts (length, prefix).
3. The surviving keys go into a second bitmap. A third scan reads and hashes the full
   content of texts whose key survives and of no others (a false hit of a bitmap
   costs one hash, never a row).
4. Survivors are counted by (length, full hash) with map-side combine and joined back
   on narrow rows; a group that holds a third of all rows is a few partial sums and a
   join that adaptive execution splits.

Texts never enter a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import bits_for, key_bitmap, with_membership
from loomgraph.storage import Scratch, discard, materialise

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    """The text with each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def _refined(docs: DataFrame, id_column: str, text_column: str, prefix_chars: int, bits: int, digest: bool) -> tuple[DataFrame, DataFrame]:
    """Rows ``(_id, _len, _survives, _full)`` and groups ``(_len, _full, keep_id, group_size)`` of the survivors, both written."""
    sized = docs.select(F.col(id_column).alias("_id"), normalised(text_column).alias("_norm")).withColumn("_len", F.octet_length("_norm"))
    prefix = F.xxhash64(F.substring("_norm", 1, prefix_chars))

    lengths = sized.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len")
    lengths = materialise(key_bitmap(lengths, ["_len"], bits), "lengths")
    again = with_membership(sized, ["_len"], lengths, "_again", bits)
    keys = again.where("_again").select("_len", prefix.alias("_prefix")).groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
    keys = materialise(key_bitmap(keys, ["_len", "_prefix"], bits), "prefixes")
    # No prefix is taken of a length that is settled: such a row has a null and can't survive.
    again = again.withColumn("_prefix", F.when(F.col("_again"), prefix))
    known = with_membership(again, ["_len", "_prefix"], keys, "_hit", bits).withColumn("_survives", F.col("_again") & F.col("_hit"))
    full = F.sha2("_norm", 256)
    rows = materialise(known.select("_id", "_len", "_survives", (full if digest else F.when(F.col("_survives"), full)).alias("_full")), "hashed")
    # Written first, so that both sides of the join are shuffled for it and a hot group can be split.
    groups = rows.where("_survives").groupBy("_len", "_full").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialise(groups, "groups")
    discard(lengths, keys)
    return rows, groups


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, prefix_chars: int = 128, bits: int = 1 << 23, digest: str | None = None
) -> DataFrame:
    """Return ``(id, keep_id, group_size, kept)``, a row for each row of ``docs``.

    Rows are copies when their normalised texts are equal; the least id of a group
    stays. Null and empty texts are one group. Rows that repeat an id and its text
    count in ``group_size`` and are flagged alike. A null id is never the least
    unless all of its group are null; then ``kept`` is true. Columns of ``docs``
    beyond the two named are ignored, so their names can't clash. With ``digest``, a
    column of that name has the SHA-256 of every normalised text, settled or not;
    it is then the full hash of the survivors too. An empty table gives an empty result.
    """
    rows, groups = _refined(docs, id_column, text_column, prefix_chars, bits, digest is not None)
    found = rows.where("_survives").join(groups, ["_len", "_full"]).select("_id", "keep_id", "group_size", "_full")
    alone = rows.where("not _survives").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_full")
    columns = [F.col("_id").alias(id_column), "keep_id", "group_size", F.expr("_id <=> keep_id").alias("kept")]
    return found.unionByName(alone).select(*columns, *([F.col("_full").alias(digest)] if digest else []))


def keep_first_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, prefix_chars: int = 128, bits: int = 1 << 23) -> DataFrame:
    """``docs`` less every copy but one, all columns as they were.

    Of equal texts the row of least id stays, a null id only where all of its group are
    null; of rows that repeat both id and text one stays, whichever. Texts, not ids,
    are what is told apart, so an id may come with several texts and each is kept once.
    An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, groups = _refined(docs, id_column, text_column, prefix_chars, bits, False)
        copied = groups.where("group_size > 1")
        # Copied texts by id: the id of its group that stays, and how many rows have that id.
        held = rows.where("_survives").join(copied, ["_len", "_full"]).groupBy("_full", "_id").agg(F.first("keep_id").alias("__lg_keep"), F.count("*").alias("__lg_n"))
        held = held.select(F.col("_id").alias("__lg_id"), F.col("_full").alias("__lg_full"), F.expr("_id <=> __lg_keep").alias("__lg_stays"), "__lg_n")
        held = scratch.keep(materialise(held, "copies"))
    # Only texts whose id is listed are hashed again; those that stay as single rows are not in the lists.
    listed = held.where("not __lg_stays or __lg_n > 1")
    bits = bits_for(listed.count())
    marked = with_membership(docs, [id_column], key_bitmap(listed.select(F.col("__lg_id").alias(id_column)), [id_column], bits), "__lg_maybe", bits)
    free = marked.where("not __lg_maybe").select(*docs.columns)
    maybe = marked.where("__lg_maybe").withColumn("__lg_hash", F.sha2(normalised(text_column), 256))
    same = F.col(id_column).eqNullSafe(F.col("__lg_id")) & (F.col("__lg_hash") == F.col("__lg_full"))
    rest = maybe.join(listed.hint("merge"), same, "left_anti").select(*docs.columns)
    twice = maybe.join(held.where("__lg_stays and __lg_n > 1"), same, "left_semi").dropDuplicates(["__lg_hash"]).select(*docs.columns)
    return free.unionByName(rest).unionByName(twice)
