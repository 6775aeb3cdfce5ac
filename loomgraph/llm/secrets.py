"""Secrets: fixed patterns, and strings of high entropy in a sliding window.

A byte mask over whole Arrow buffers finds the texts that can hold anything: a
run of 20 token characters or a keyword. Only those are read as strings. In each
candidate string (a run of token characters) a window moves one character at a
time; counts of the window's characters, and the sum of ``c * log2(c)`` over them,
are updated from the one that leaves and the one that enters. A string that somewhere
reaches the entropy of its character class (hex, letters of one case with digits,
letters of both cases, or all of these) is a secret, unless the allow list knows what
it is. Strings of digits alone, or of letters of one case, are none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.lexing import slabs
from loomgraph.llm.pii import apart
from loomgraph.storage import bounded_batches

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least bits a character in the best window, by class. In 20 random characters hex has about 3.4, one case
#: with digits 3.9, both cases 4.1 and base64 4.1; words run together have 3.4 to 3.8.
LEAST_BITS = {"hex": 3.0, "lower": 3.75, "upper": 3.7, "letters": 3.9, "mixed": 3.7}
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    # Words, capitalised, in capitals or neither, run together or joined by marks, with one short number between or after.
    re.compile(r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)[-_/+=]*+)++(?:[0-9]{1,4}+[-_/+=]*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)[-_/+=]*+)*+)?"),
    re.compile(r"(\d{1,4}[-/_])+\d{1,4}"),  # dates and ranges
    re.compile(r"[=_+/-]*"),  # rules
)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, ``(start, stop, kind)`` by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    # Characters of these two kinds are token characters, so long matches lie in long runs.
    for run in _RUN.finditer(text):
        at, string = run.start(), run.group()
        found += [(at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(string) if m.end() - m.start() >= 20]
        found += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(string) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def best_window_bits(string: str, width: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits a character, of any window; the whole string where it is shorter."""
    width = min(width, len(string))
    if not width:
        return 0.0
    terms = [0.0] + [c * log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    least = float("inf")
    for i, new in enumerate(string):
        if i >= width:
            old = string[i - width]
            c = counts[old]
            total += terms[c - 1] - terms[c]
            counts[old] = c - 1
        c = counts.get(new, 0)
        total += terms[c + 1] - terms[c]
        counts[new] = c + 1
        if i >= width - 1:
            least = min(least, total)
    return log2(width) - least / width


def character_class(string: str) -> str | None:
    """``hex``, ``lower`` or ``upper`` (with digits), ``letters`` (of both cases), ``mixed`` (with digits), or None for what is no candidate."""
    digit = any("0" <= c <= "9" for c in string)
    lower, upper = any("a" <= c <= "z" for c in string), any("A" <= c <= "Z" for c in string)
    if digit and (lower or upper) and all(c in "0123456789abcdefABCDEF" for c in string):
        return "hex"
    if lower and upper:
        return "mixed" if digit else "letters"
    return ("lower" if lower else "upper") if digit and (lower or upper) else None


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidate strings of high entropy that the allow list doesn't suppress."""
    found = []
    for run in _RUN.finditer(text):
        string = run.group()
        kind = character_class(string)
        if kind and not any(p.fullmatch(string) for p in ALLOWED) and best_window_bits(string) >= LEAST_BITS[kind]:
            found.append((run.start(), run.end(), "entropy"))
    return found


def find_secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: a string of high entropy inside a base span is not told twice."""
    base = base_spans(text)
    added = apart(entropy_spans(text), base)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _suspects(texts: pa.Array) -> np.ndarray:
    """Which texts hold a keyword or a long run of token characters."""
    out = np.zeros(len(texts), dtype=bool)
    for slab in slabs(texts):
        if not len(slab.data):
            continue
        edges = np.diff(np.concatenate([[False], _TOKEN[slab.data], [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        places = [starts[stops - starts >= WINDOW]]
        # A run may go on into the next text; whoever holds 20 of it is looked at, by its stop too.
        places.append(stops[stops - starts >= WINDOW] - 1)
        low = slab.data.tobytes().translate(_LOWER)
        for word in _KEYWORDS:
            at = low.find(word)
            while at >= 0:
                places.append(np.array([at]))
                at = low.find(word, at + 1)
        where = np.concatenate(places)
        out[slab.first + np.searchsorted(slab.offsets, where, side="right") - 1] = True
        for a, b in zip(starts[stops - starts >= WINDOW], stops[stops - starts >= WINDOW], strict=True):
            first, last = np.searchsorted(slab.offsets, [a, b - 1], side="right") - 1
            out[slab.first + first : slab.first + last + 1] = True
    return out


def span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for start, stop, kind in spans)


def _scan() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column("text")
            n = batch.num_rows
            counts = np.zeros((3, n), dtype=np.int64)
            digest, spans = [nothing] * n, [""] * n
            for i in np.flatnonzero(_suspects(texts)):
                base, found = find_secrets(texts[i].as_py() or "")
                for *_, kind in base:
                    counts[KINDS.index(kind), i] += 1
                digest[i] = hashlib.sha256(span_text(base).encode()).hexdigest()
                spans[i] = span_text(found)
            yield pa.record_batch([batch.column("id"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return ``(id, n_assign, n_access, n_hex, base_sha256, spans)``, a row for each row of ``docs``.

    Counts and ``base_sha256`` are of the fixed patterns; ``spans`` lists all as
    ``kind:start:stop`` in code points, by start, then kind. A null text counts as
    empty and has no spans. Rows that repeat an id are scanned one by one; a null
    id stays null. Other columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(_scan(), schema).withColumnRenamed("id", id_column)
