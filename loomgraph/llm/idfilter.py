"""Row keys, and a bounded bitmap of hashed keys as a broadcast prefilter for key joins.

Joining whole texts to a list of ids shuffles every text. The bitmap has a fixed
size whatever the number of keys, is broadcast, and lets rows whose key can't be
listed pass by without a shuffle; only rows that may be listed go to the exact
join. A saturated bitmap costs time, never results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32768  # bits in one bitmap of Spark's bitmap aggregates
DEFAULT_BITS = 1 << 23
MOST_BITS = 1 << 26
NAMELESS = 1 << 62  # rows without an id get numbers from here on: after all others


def node(id_column: str, text_column: str) -> Column:
    """A row's id as a long; without one, a number after all ids that is a hash of the text."""
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))), 2)
    return F.coalesce(F.col(id_column).cast("long"), nameless)


def key_bitmap(keys: DataFrame, columns: list[str], bits: int = DEFAULT_BITS) -> DataFrame:
    """Rows ``(__lg_page, __lg_words)``, at most ``bits / 32768`` of 4 KB each, each page as 512 longs."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    pages = (
        keys.select(slot.alias("__lg_slot"))
        .groupBy(F.floor(F.col("__lg_slot") / PAGE).cast("int").alias("__lg_page"))
        .agg(F.bitmap_construct_agg(F.col("__lg_slot") % PAGE).alias("__lg_bits"))
    )
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("__lg_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return pages.select("__lg_page", words.alias("__lg_words"))


def with_membership(df: DataFrame, columns: list[str], bitmap: DataFrame, flag: str, bits: int = DEFAULT_BITS) -> DataFrame:
    """Add boolean ``flag``: false where the key is surely absent from the bitmap."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    spread = df.withColumn("__lg_slot", slot).withColumn("__lg_page", F.floor(F.col("__lg_slot") / PAGE).cast("int"))
    # Bit b of a page is bit b % 8 of byte b / 8, and a long holds its first byte on top.
    hit = F.expr("(shiftright(__lg_words[cast((__lg_slot % 32768) div 64 as int)], cast((7 - (__lg_slot div 8) % 8) * 8 + __lg_slot % 8 as int)) & 1) = 1")
    return spread.join(F.broadcast(bitmap), "__lg_page", "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__lg_page", "__lg_slot", "__lg_words")


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    """Bits that leave about one false hit in sixteen: a power of two, at most 8 MB of them."""
    return min(most, max(1 << 18, 1 << (16 * max(1, keys) - 1).bit_length()))


def without_ids(df: DataFrame, id_column: str, dropped: DataFrame) -> DataFrame:
    """``df`` less the rows whose ``id_column`` is in ``dropped(id_column)``, a written table; rows with a null id stay."""
    bits = bits_for(dropped.count())
    marked = with_membership(df, [id_column], key_bitmap(dropped, [id_column], bits), "__lg_maybe", bits)
    # The same join at every size: a broadcast of small lists would only move the cost to large ones.
    rest = marked.where("__lg_maybe").join(dropped.select(id_column).distinct().hint("merge"), id_column, "left_anti")
    return marked.where("not __lg_maybe").select(*df.columns).unionByName(rest.select(*df.columns))
