"""Text normalisation, sentences, slugs, shingles: column expressions, with one Arrow function for NFKC."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "Dr", "Mr", "Mrs", "Ms", "vs", "Fig", "Eq", "No", "Inc", "Ltd", "U.S", "Ph.D",
    "St", "Dept", "Univ", "Corp", "Co", "Prof", "Rev", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug",
    "Sep", "Oct", "Nov", "Dec", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun",
)
_GUARD = "\x01"
_CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{feff}]"


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Unicode compatibility composition; no built-in function does it, and Arrow's leaves letters apart from their accents."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in s.to_pylist()], pa.string())


def strip(s: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _blanks(s: Column) -> Column:
    s = F.regexp_replace(s, r"(?U)[^\S\n]+", " ")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def normalise(s: Column) -> Column:
    """NFKC; no control or zero-width characters; runs of blanks as one space and of newlines as two at most; stripped."""
    return _blanks(F.regexp_replace(nfkc(s), _CONTROL, ""))


def clean_text(s: Column) -> Column:
    """Normalised, words hyphenated over a line end joined, lines that hold only a page number dropped. One pass.

    What is joined and dropped are ASCII letters and digits, so the text stays composed and only blanks are seen to again.
    """
    s = F.regexp_replace(normalise(s), r"(?U)(\b[A-Za-z]{2,})-\n([A-Za-z]{2,}\b)", "$1$2")
    s = F.regexp_replace(s, r"(?mU)^\s*\d{1,4}\s*$", "")
    return _blanks(s)


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits, everything between as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(normalise(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ascii_slug(name: Column) -> Column:
    """``slug`` of a name known to be ASCII, without leaving the JVM."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def entity_key(label: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lower(label), slug(name))


def sentences(s: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before a blank and an ASCII capital or a quote, not after an abbreviation."""
    words = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
    s = F.regexp_replace(s, rf"(?i)\b({words})\.", f"$1{_GUARD}")
    parts = F.split(s, r'(?<=[.!?])\s+(?=[A-Z"])')
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit(_GUARD), F.lit(".")))), lambda p: p != "")


def pack(parts: Column, limit: int) -> Column:
    """Greedy packing of strings, joined by spaces, into pieces of about ``limit`` characters; a longer one stays whole."""
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(acc: Column, part: Column) -> Column:
        n = F.length(part)
        full = (acc["size"] + n + 1 > limit) & (acc["size"] > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["size"] == 0), part).otherwise(F.concat(acc["now"], F.lit(" "), part)).alias("now"),
            F.when(full, n).otherwise(acc["size"] + n + 1).alias("size"),
        )

    return F.aggregate(parts, first, step, lambda acc: F.when(acc["size"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def hard_split(s: Column, limit: int) -> Column:
    """Words packed to ``limit`` characters."""
    return pack(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""), limit)


def tokens(s: Column) -> Column:
    """Lower-case words of the normalised text."""
    return F.filter(F.split(F.lower(normalise(s)), r"(?U)\s+"), lambda w: w != "")


_PLAIN_CONTROL = re.compile("[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f\u200b-\u200f\ufeff]")


def plain_tokens(text: str) -> list[str]:
    """``tokens`` of one text in Python, for functions over whole documents."""
    return _PLAIN_CONTROL.sub("", text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().split()


def shingles(words: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` words, none for shorter texts."""

    def runs(bound: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(bound) - (k - 1)), lambda i: F.array_join(F.slice(bound, i, k), " ")))

    none = F.array().cast("array<string>")
    # The words are bound as an array's one element: inside a lambda an expression would be computed at every step.
    return F.coalesce(F.transform(F.array(words), lambda w: F.when(F.size(w) >= k, runs(w)).otherwise(none))[0], none)


# What is taken out of Markdown, in this order, and what stays of it.
MARKDOWN = (
    (r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"(?dm)^#{1,6}\s+", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\*{1,2}([^*]+)\*{1,2}", "$1"), (r"_{1,2}([^_]+)_{1,2}", "$1"),
)


def strip_markdown(s: Column) -> Column:
    """Text of Markdown without code, heading and emphasis marks; links and images leave their display text."""
    for pattern, to in MARKDOWN:
        s = F.regexp_replace(s, pattern, to)
    return s
