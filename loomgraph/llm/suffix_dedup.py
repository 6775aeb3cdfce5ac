"""Removal of byte strings that already stand earlier in the corpus, by a logarithmic family of suffix arrays.

A suffix array here is a table of sampled suffixes in the order of their bytes.
Suffixes are sampled at winnowed anchors (see ``repeats``), where a match of
``window_bytes`` must have one, and hold as many bytes before and after the anchor
as windows can reach. Equal suffixes stand in the array once, for the first of
them. Texts come in batches of rising ids. For each new batch

1. its suffixes are sorted by range together with those of the levels that it will
   merge with, and with the suffixes of the other levels that begin with a gram of
   the batch: one merge-scan of the batch against every level;
2. neighbours in this order are compared byte by byte; common lengths before and after
   the anchor of at least ``window_bytes`` in all are matches, and a window of the
   batch that stands in a level or earlier in the batch is a repeat;
3. the sorted table, without what was only read along, is the new level: levels of
   equal size merge, so ``n`` batches leave at most ``log2(n) + 1`` tables.

A level's texts are all earlier than a new batch's, so a repeat found once stays one
whatever comes later; results of earlier batches never change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import bits_for, key_bitmap, with_membership
from loomgraph.llm.repeats import ENTRY_COLUMNS, Repeats, extended, found_spans, named, numbered_texts, repeated_spans, span_arrays, with_spans
from loomgraph.storage import discard, materialise, release


class SuffixLevels:
    """The family of sorted suffix tables and the merge-scan of a new batch against it.

    ``levels`` maps a size, as a power of two in batches, to ``(table, entries)``.
    """

    def __init__(self, spec: Repeats) -> None:
        self.spec = spec
        self.levels: dict[int, tuple[DataFrame, DataFrame]] = {}

    def add(self, batch: DataFrame) -> DataFrame:
        """Spans ``(id, start, stop)`` of the batch's windows that stand in a level or earlier in the batch; the batch joins the family."""
        size, joined = 0, []
        while size in self.levels:
            joined.append(self.levels.pop(size))
            size += 1
        fresh = lambda df, new, stays: df.select(*ENTRY_COLUMNS, F.lit(new).alias("fresh"), F.lit(stays).alias("stays"))
        rows = fresh(batch, True, True)
        for _, level in joined:
            rows = rows.unionByName(fresh(level, False, True))
        if self.levels:
            bits = bits_for(batch.count())
            grams = materialise(key_bitmap(batch, ["gram"], bits), "grams")
            for _, level in self.levels.values():
                met = with_membership(level, ["gram"], grams, "__lg_met", bits).where("__lg_met")
                rows = rows.unionByName(fresh(met, False, False))
        rows = materialise(rows, "rows")
        array = materialise(extended(rows, self.spec), "level")
        found = materialise(found_spans(array, self.spec, "fresh"), "found")
        discard(rows, *(table for table, _ in joined))
        self.levels[size] = (array, array.where("stays").select(*ENTRY_COLUMNS))
        release(batch.sparkSession)
        return found


def _level_spans(batches: int):
    def extend(entries: DataFrame, spec: Repeats) -> DataFrame:
        cuts = entries.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
        edges = [None, *sorted(set(cuts)), None]
        family = SuffixLevels(spec)
        found = None
        for low, high in zip(edges, edges[1:], strict=False):
            batch = entries
            if low is not None:
                batch = batch.where(F.col("id") > low)
            if high is not None:
                batch = batch.where(F.col("id") <= high)
            new = family.add(batch)
            found = new if found is None else found.unionByName(new)
        discard(entries, *(table for table, _ in family.levels.values()))
        return found

    return extend


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, runs, digest = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = (text.as_py() or "").encode()
            starts, stops = span_arrays(spans)
            sha, at = hashlib.sha256(), 0
            for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
                sha.update(data[at:start])
                at = stop
            sha.update(data[at:])
            total.append(len(data))
            gone.append(int(np.sum(stops - starts)))
            runs.append(len(starts))
            digest.append(sha.hexdigest())
        ints = [pa.array(x, pa.int64()) for x in (total, gone, runs)]
        yield pa.record_batch([batch.column("id"), *ints, pa.array(digest, pa.string()), batch.column("spans")], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, window_bytes: int = 100, gram_bytes: int = 64, batches: int = 4) -> DataFrame:
    """Return ``(id, n_bytes, n_removed, n_spans, kept_sha256, spans)``, a row for each row of ``docs``.

    A byte of the UTF-8 text goes when a string of ``window_bytes`` bytes that
    covers it also starts earlier (smaller id, or same text and earlier start).
    ``spans`` holds the removed strings, overlaps not yet joined; ``n_spans``
    counts the maximal ones; null where nothing is removed. A null or empty text
    has no bytes. Rows that repeat an id are taken for one text. A row without an id
    comes after all others and its text stands for it. Other columns are ignored. Ids
    are integers under 2**62. An empty table gives an empty result.
    """
    texts = numbered_texts(docs, id_column, text_column)
    spans = repeated_spans(texts, Repeats("byte", window_bytes, gram_bytes), _level_spans(batches))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"
    return named(with_spans(texts, spans, _render, schema), id_column)
