"""Seed and extend: find what repeats, word for word or byte for byte, in a corpus.

A *window* is ``length`` neighbouring items (words or bytes) of one text. It
repeats when the same items also start earlier: in a text of smaller id, or
before it in the same text.

Seeds. Every window picks its anchor: the least hash of the ``gram``-item runs
inside it (winnowing). The choice depends on the window's items alone, so equal
windows pick equal anchors at equal offsets, and about ``2 / (length - gram + 2)``
of the positions are anchors. An anchor whose gram occurs once in the corpus
settles all its windows. The others' grams go into a bitmap of fixed size. The
windows of one anchor lie side by side; the stretch they cover is the anchor's
*region*. A region that occurs more than once is extended once: the first one
stands for all, told by 96 bits beside the gram, and the others repeat it as a whole.

Extension. Only where one gram has several different regions can windows repeat
in part. The first regions of each kind are sorted by their items from the anchor
on, which is the order of a suffix array. Neighbours are compared item by item, to
the right in this order and to the left in the order of what stands before the
anchor; the two common lengths tell, for every window of every region, which
others are equal to it. Windows that repeat an earlier one join into maximal spans.

Sorted regions are scanned in chunks. A class of equal windows can only go on in
another chunk if it agrees with the first or the last row of its own in all items from
the anchor on. The first rows of such classes are sorted again, by what stands before
the anchor, and scanned in chunks of that order; where a class still may go on, its
first window is noted with a 128-bit digest, and notes are matched by a sum with
map-side combine. So a gram that a third of all rows share is many chunks, and no
list of its places is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import NAMELESS, bits_for, key_bitmap, node, with_membership
from loomgraph.llm.lexing import Slab, byte_values, mix, owners, rolling, slabs, sliding_argmin, spans_hash, tidy
from loomgraph.storage import bounded_batches, discard, materialise, release

PIECE = 1 << 19
CHUNK = 1 << 14
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)

ENTRY = "gram long, id long, start int, runs int, at int, context binary"
ENTRY_COLUMNS = ("gram", "id", "start", "runs", "at", "context")


@dataclass(frozen=True)
class Repeats:
    """What counts as a repeat: the unit (``word`` or ``byte``), the window and the gram, and the bitmap's bits."""

    unit: str
    length: int
    gram: int
    bits: int = 1 << 26

    @property
    def kind(self) -> type:
        return np.uint64 if self.unit == "word" else np.uint8

    @property
    def lead(self) -> int:
        """How many items of a window may stand before its anchor."""
        return self.length - self.gram

    def items(self, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
        """Items of a slab, bytes or hashes of words, and where each text's begin (one more entry than texts)."""
        return slab.words(lower=False) if self.unit == "word" else (slab.data, slab.offsets)

    def pieces(self, slab: Slab) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Values of the items, a bounded number at a time, with the place in the text where they begin.

        A long text comes in pieces that overlap by all but one item of a window, so each window lies in one piece.
        """
        items, begins = self.items(slab)
        values = (lambda x: x) if self.unit == "word" else byte_values
        if len(begins) > 2 or len(items) <= PIECE:
            yield 0, values(items), begins
            return
        for lo in range(0, len(items) - self.length + 1, PIECE):
            part = items[lo : lo + PIECE + self.length - 1]
            yield lo, values(part), np.array([0, len(part)])

    def anchors(self, values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each anchor: its gram's hash, its text, the first window that picks it, how many do, and its place from there."""
        size = len(values) - self.length + 1
        if size <= 0:
            return (np.empty(0, dtype=np.uint64), *[np.empty(0, dtype=np.int64)] * 4)
        grams = rolling(values, self.gram)
        text = owners(begins, len(values))[:size]
        places = np.flatnonzero(np.arange(size) + self.length <= begins[1:][text])
        at = sliding_argmin(grams, self.lead + 1)[places]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        runs = np.diff(np.append(first, len(at)))
        starts = places[first]
        return grams[at[first]], text[starts], starts, runs, at[first] - starts


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _ints(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int32))


def _grams(spec: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                for _, values, begins in spec.pieces(slab):
                    grams, times = np.unique(spec.anchors(values, begins)[0], return_counts=True)
                    yield pa.record_batch([_signed(grams), pa.array(times)], names=["gram", "n"])

    return tidy(run)


def _regions(spec: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for slab in slabs(batch.column("text")):
                for base, values, begins in spec.pieces(slab):
                    grams, text, starts, runs, at = spec.anchors(values, begins)
                    stops = starts + runs - 1 + spec.length
                    whole, other = (spans_hash(v, starts, stops) for v in (values, mix(values ^ _OTHER)))
                    yield pa.record_batch(
                        [_signed(grams), _signed(whole), _ints(other.view(np.int64) >> 32), pa.array(ids[slab.first + text]), _ints(starts - begins[text] + base), _ints(runs), _ints(at)],
                        names=["gram", "whole", "other", "id", "start", "runs", "at"],
                    )

    return tidy(run)


def cut(items: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The items of many spans as binary values."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    source = np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())
    offsets = np.concatenate([[0], ends * items.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(items[source].tobytes())])


def _contexts(spec: Repeats) -> Callable:
    """The regions of each text with their items."""
    fields = ("gram", "start", "runs", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, regions = batch.column("id").to_pylist(), batch.column("regions")
            for slab in slabs(batch.column("text")):
                items, begins = spec.items(slab)
                for i, (begin, end) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                    found = regions[slab.first + i].values
                    gram, start, runs, at = (found.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in fields)
                    stop = start + runs - 1 + spec.length
                    inside = begin + stop <= end  # rows may wrongly share an id
                    gram, start, runs, at, stop = (x[inside] for x in (gram, start, runs, at, stop))
                    for lo in range(0, len(gram), CHUNK):
                        part = slice(lo, lo + CHUNK)
                        context = cut(items, begin + start[part], begin + stop[part])
                        doc = pa.array(np.full(len(context), ids[slab.first + i]))
                        yield pa.record_batch([pa.array(gram[part]), doc, _ints(start[part]), _ints(runs[part]), _ints(at[part]), context], names=ENTRY_COLUMNS)

    return tidy(run)


def _beside(flat: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Items at the given places (a matrix), 0 outside ``low`` and ``high`` of a row."""
    inside = (places >= low[:, None]) & (places < high[:, None])
    return np.where(inside, flat[np.clip(places, 0, max(0, len(flat) - 1))], flat.dtype.type(0))


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many leading items each row shares with the row before it; -1 for the first."""
    out = np.full(len(rows), -1, dtype=np.int64)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def _by_items(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of rows by their items, of rows that only fill up with zeros the shorter first."""
    if rows.dtype == np.uint8:
        wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
        wide[:, : rows.shape[1]] = rows
        rows = wide.view(">u8").astype(np.uint64)
    return np.lexsort((sizes, *rows.T[::-1]))


def _digests(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row of items, in two halves."""
    place = np.arange(items.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide = items.astype(np.uint64) + np.uint64(1)
    return tuple(mix(mix(mix(wide * odd) + place).sum(axis=1, dtype=np.uint64)) for odd in (_OTHER, np.uint64(0x165667B19E3779F9)))


@dataclass
class Extended:
    """What a chunk tells of its rows: repeated windows as spans, and windows that are the first of a class with no end in sight."""

    spans: tuple[np.ndarray, np.ndarray, np.ndarray]  # row, start, stop
    open: tuple[np.ndarray, np.ndarray]  # row, items before the anchor
    back: np.ndarray  # items before the anchor, the nearest first
    places: np.ndarray  # where the anchor is among ``items``
    items: np.ndarray


def extend_chunk(spec: Repeats, entries: pa.Table, by_left: bool = False) -> Extended:
    """Compare the regions of one sorted chunk with each other.

    Rows come in the order of their items from the anchor on or, ``by_left``, of
    those before it; then only windows in ``open`` count, a bit for each number of
    items before the anchor.
    """
    n, length, lead = len(entries), spec.length, spec.lead
    number = lambda c: entries.column(c).to_numpy().astype(np.int64)
    ids, start, runs, at = (number(c) for c in ("id", "start", "runs", "at"))
    context = entries.column("context").combine_chunks()
    offsets = np.frombuffer(context.buffers()[1], dtype=np.int32)[context.offset : context.offset + n + 1].astype(np.int64)
    size = np.dtype(spec.kind).itemsize
    flat = np.frombuffer(context.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(spec.kind)
    begin, end = (offsets[:-1] - offsets[0]) // size, (offsets[1:] - offsets[0]) // size
    anchor = begin + at
    right = _beside(flat, anchor[:, None] + np.arange(length), anchor, end)
    left = _beside(flat, anchor[:, None] - 1 - np.arange(lead), begin, anchor)
    by_right, before = _by_items(right, end - anchor), _by_items(left, at)
    shared_right, shared_left = _common(right[by_right], (end - anchor)[by_right]), _common(left[before], at[before])
    rank = np.lexsort((start, ids))  # rows from the earliest on
    wanted = number("open") if by_left else np.full(n, -1)
    repeated = np.zeros((n, lead + 1), dtype=bool)
    open_rows, open_at = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    forward, backward = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(lead + 1):
        rows = rank[(o <= at[rank]) & (o > (at - runs)[rank]) & ((wanted[rank] >> o) & 1 == 1)]
        if not len(rows):
            continue
        forward[by_right], backward[before] = np.cumsum(shared_right < length - o), np.cumsum(shared_left < o)
        key = forward[rows] * (n + 1) + backward[rows]
        order = np.argsort(key, kind="stable")
        first = np.diff(key[order], prepend=-1) != 0
        rows = rows[order]
        head = rows[np.flatnonzero(first)[np.cumsum(first) - 1]]
        repeated[rows, o] = (ids[rows] != ids[head]) | (start[rows] != start[head])  # a repeated row is no repeat
        heads, side = rows[first], backward if by_left else forward
        heads = heads[(side[heads] == side[0]) | (side[heads] == side[-1])]
        open_rows.append(heads)
        open_at.append(np.full(len(heads), o))
    # Window ``start + k`` has ``at - k`` items before the anchor: neighbouring windows are neighbouring columns.
    edges = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1] - 1
    spans = (row, start[row] + at[row] - high, start[row] + at[row] - low + length)
    return Extended(spans, (np.concatenate(open_rows), np.concatenate(open_at)), left, anchor, flat)


def _listed(n: int, rows: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
    """A list of structs for each of ``n`` rows."""
    order = np.argsort(rows, kind="stable")
    offsets = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c[order]) for c in columns.values()], names=list(columns)))


_SPANS = "spans array<struct<start:int,stop:int>>"
_NOTES = "notes array<struct<start:int,half:long,other:long>>"


def _first_pass(spec: Repeats, table: pa.Table) -> pa.Table:
    done, n = extend_chunk(spec, table), len(table)
    row, a, b = done.spans
    rows, at = done.open
    bits = np.zeros(n, dtype=np.int64)
    np.bitwise_or.at(bits, rows, np.int64(1) << at)
    starts = np.arange(n) * spec.lead
    back = cut(done.back.ravel(), starts, starts + np.where(bits != 0, table.column("at").to_numpy(), 0))
    spans = _listed(n, row, {"start": a.astype(np.int32), "stop": b.astype(np.int32)})
    return table.append_column("spans", spans).append_column("open", pa.array(bits)).append_column("back", back)


def _second_pass(spec: Repeats, table: pa.Table) -> pa.Table:
    done, n = extend_chunk(spec, table, by_left=True), len(table)
    row, a, b = done.spans
    rows, at = done.open
    halves: tuple[list, list] = ([np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)])
    for lo in range(0, len(rows), 4096):
        some = slice(lo, lo + 4096)
        for out, half in zip(halves, _digests(done.items[(done.places[rows[some]] - at[some])[:, None] + np.arange(spec.length)]), strict=True):
            out.append(half)
    start = table.column("start").to_numpy()[rows] + table.column("at").to_numpy()[rows] - at
    notes = _listed(n, rows, {"start": start.astype(np.int32), "half": np.concatenate(halves[0]).view(np.int64), "other": np.concatenate(halves[1]).view(np.int64)})
    spans = _listed(n, row, {"start": a.astype(np.int32), "stop": b.astype(np.int32)})
    return table.select(["id", "wanted"]).append_column("spans", spans).append_column("notes", notes)


def _chunked(spec: Repeats, function: Callable[[Repeats, pa.Table], pa.Table]) -> Callable:
    """``function`` on the rows of a partition, in order, ``CHUNK`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                if rows + part.num_rows > CHUNK:
                    yield from function(spec, pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=8192)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from function(spec, pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=8192)

    return tidy(run)


def extended(entries: DataFrame, spec: Repeats) -> DataFrame:
    """``entries`` in the order of their items from the anchor on, with ``spans``, and ``open`` and ``back`` of windows to be looked at again.

    ``entries`` is a written table. Ranges go by id and start too, so equal regions are many tasks where they are many.
    """
    size = np.dtype(spec.kind).itemsize
    suffix = F.substring("context", F.col("at") * size + 1, F.lit(spec.length * size))
    order = [suffix, "id", "start"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunked(spec, _first_pass), f"{fields}, {_SPANS}, open long, back binary")


def found_spans(compared: DataFrame, spec: Repeats, wanted: str = "true") -> DataFrame:
    """Spans ``(id, start, stop)`` of the ``wanted`` rows of a written table that ``extended`` gave.

    To those of the chunks come the windows whose class no chunk had whole: first by the
    order of what stands before the anchor, then by digest.
    """
    order = ["back", "id", "start"]
    again = materialise(compared.where("open <> 0").select(*ENTRY_COLUMNS, "open", "back", F.expr(wanted).alias("wanted")), "open")
    second = again.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunked(spec, _second_pass), f"id long, wanted boolean, {_SPANS}, {_NOTES}")
    second = materialise(second, "extended")
    discard(again)
    spans = compared.where(wanted).select("id", "spans").union(second.where("wanted").select("id", "spans"))
    spans = spans.select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.stop")
    notes = second.select("id", "wanted", F.explode("notes").alias("n")).select("id", "wanted", "n.*")
    first = notes.groupBy("half", "other").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").drop("n"), "firsts")
    later = notes.where("wanted").join(first, ["half", "other"]).where(F.struct("id", "start") > F.col("first"))
    return spans.unionByName(later.select("id", "start", (F.col("start") + spec.length).alias("stop")))


def numbered_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, text)`` with ``node`` as the id."""
    bounded_batches(docs.sparkSession)
    return docs.select(node(id_column, text_column).alias("id"), F.col(text_column).alias("text"))


def named(df: DataFrame, id_column: str) -> DataFrame:
    """Rows of ``numbered_texts`` under their own id again, null where there was none."""
    return df.withColumn("id", F.when(F.col("id") < NAMELESS, F.col("id"))).withColumnRenamed("id", id_column)


def texts_with(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``texts`` of the ids in ``lists``, a written table, with its columns; other texts take no part in the shuffle."""
    bits = bits_for(lists.count())
    maybe = with_membership(texts, ["id"], key_bitmap(lists, ["id"], bits), "__lg_maybe", bits).where("__lg_maybe").drop("__lg_maybe")
    return maybe.join(lists.hint("merge"), "id")


def repeated_spans(texts: DataFrame, spec: Repeats, extend: Callable[[DataFrame, Repeats], DataFrame]) -> DataFrame:
    """Spans ``(id, start, stop)``, in items, of windows that also start earlier; they may overlap.

    ``texts`` has ``(id, text)``; rows that repeat an id are one text. ``extend``
    gives the spans of the regions, of grams that have several, among themselves.
    """
    counts = texts.select("text").mapInArrow(_grams(spec), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = materialise(key_bitmap(counts, ["gram"], spec.bits), "grams")
    release(texts.sparkSession)
    regions = texts.mapInArrow(_regions(spec), "gram long, whole long, other int, id long, start int, runs int, at int")
    regions = with_membership(regions, ["gram"], repeated, "__lg_maybe", spec.bits).where("__lg_maybe").drop("__lg_maybe")
    regions = materialise(regions, "regions")
    discard(repeated)
    key = ["gram", "whole", "other"]
    kinds = regions.groupBy(*key).agg(F.min(F.struct("id", "start", "runs", "at")).alias("first"), F.count("*").alias("n"))
    kinds = materialise(kinds, "kinds")
    release(texts.sparkSession)
    copied = kinds.where("n > 1").select(*key, "first")
    copies = regions.join(copied, key).where(F.struct("id", "start") > F.struct("first.id", "first.start"))
    copies = materialise(copies.select("id", "start", (F.col("start") + F.col("runs") - 1 + spec.length).alias("stop")), "spans")
    discard(regions)
    release(texts.sparkSession)
    mixed = materialise(kinds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "mixed")
    lists = kinds.join(mixed, "gram").groupBy("first.id").agg(F.collect_list(F.struct("gram", "first.start", "first.runs", "first.at")).alias("regions"))
    lists = materialise(lists, "lists")
    discard(kinds, mixed)
    release(texts.sparkSession)
    entries = materialise(texts_with(texts, lists).select("id", "text", "regions").mapInArrow(_contexts(spec), ENTRY), "entries")
    discard(lists)
    return copies.unionByName(extend(entries, spec))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of overlapping or touching spans, in order."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def with_spans(texts: DataFrame, spans: DataFrame, render: Callable, schema: str) -> DataFrame:
    """Apply ``render`` to batches of ``(id, text, spans)``, ``spans`` null where a text has none.

    Texts without a span are told by a bitmap and take no part in the shuffle.
    Spans of one text are bounded by its length.
    """
    lists = materialise(spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "lists")
    release(texts.sparkSession)
    bits = bits_for(lists.count())
    marked = with_membership(texts, ["id"], key_bitmap(lists, ["id"], bits), "__lg_maybe", bits)
    kind = "array<struct<start:int,stop:int>>"
    held = marked.where("__lg_maybe").select("id", "text").join(lists.hint("merge"), "id", "left").select("id", "text", F.col("spans").cast(kind).alias("spans"))
    free = marked.where("not __lg_maybe").select("id", "text", F.lit(None).cast(kind).alias("spans"))
    return held.mapInArrow(render, schema).unionByName(free.mapInArrow(render, schema))


def span_arrays(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Merged starts and stops of one text's spans."""
    if not spans.is_valid or not len(spans.values):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return merged(*(spans.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "stop")))
