"""Removal of word sequences that already stand earlier in the corpus, by seed and extend.

Documents meet on winnowed anchors; the regions of a common anchor are compared word by
word, to the right and to the left, and runs of at least ``window_words`` equal words are
kept as maximal repeats. See ``repeats`` for the steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.repeats import Repeats, extended, found_spans, named, numbered_texts, repeated_spans, span_arrays, with_spans
from loomgraph.storage import discard, materialise


def _render(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                starts, stops = span_arrays(spans)
                left, at = [], 0
                for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
                    left += words[at:start]
                    at = stop
                left += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                joined = b" ".join(left)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if with_text else None)
            cols = [batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string()), batch.column("spans")]
            names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"]
            yield pa.record_batch(cols if with_text else cols[:4], names=names if with_text else names[:4])

    return run


def _extend(entries: DataFrame, spec: Repeats) -> DataFrame:
    context = F.when(F.col("open") != 0, F.col("context"))  # others are done
    compared = materialise(extended(entries, spec).withColumn("context", context), "extended")
    discard(entries)
    return found_spans(compared, spec)


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, window_words: int = 20, gram_words: int = 12, with_text: bool = True) -> DataFrame:
    """Return ``(id, n_words, n_removed, kept_sha256)`` and, ``with_text``, ``kept_text`` and the raw ``spans``.

    Words are runs without ASCII blanks. A word goes when a window of
    ``window_words`` words that covers it also starts earlier (smaller id, or same
    text and earlier start); windows are judged on the input. Kept words are
    joined by one space. A null or empty text has no words; texts shorter than a
    window lose nothing. Rows that repeat an id are taken for one text: they don't
    repeat each other. A row without an id comes after all others and its text stands for
    it. Other columns are ignored. Ids are integers under 2**62. An empty table gives an
    empty result.
    """
    texts = numbered_texts(docs, id_column, text_column)
    spans = repeated_spans(texts, Repeats("word", window_words, gram_words), _extend)
    schema = "id long, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept_text string, spans array<struct<start:int,stop:int>>" if with_text else ""
    return named(with_spans(texts, spans, _render(with_text), schema), id_column)
