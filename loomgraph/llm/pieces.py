"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The vocabulary of a SentencePiece model spans a lattice over each text: an edge
is a piece, a path a segmentation. A BPE model ranks its pieces but gives them no
probabilities; the lattice takes Zipf's law of the rank, ``-log(rank + 3)``. A
character without a piece is spelled in byte pieces, so decoding is exact.

Sampling is a perturbed A* search. Backward log sums make every edge's chance
known, so the mass of all completions of a prefix is exact and serves as the
heuristic. The root draws a Gumbel; the first path is drawn from the top with the
root's value. What is left falls into disjoint sets: at each step of a path the
other edges with all that follows. Each set's best perturbed value is a Gumbel of
its mass cut off at the path's value, so the search pops the best set, draws its
best path from the node where it leaves, and splits the rest again. The first k
paths are a sample of k distinct segmentations without replacement; the best value
left over is the threshold of their inclusion scores.

No piece crosses the start of a run of blanks, so lattices are built once for each
distinct stretch between such places of a slab and shared by its occurrences;
the walk from node to node is vectorised over all of them. Random numbers are a
hash of seed, row key, path and byte, the same in any partitioning.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.lexing import Slab, hash_spans, mix, slabs, tidy
from loomgraph.storage import bounded_batches

SPACE = 32
SLAB = 1 << 19
_BLANK_PIECE = "▁"
FIRST_BYTE = 3  # the id of the piece for byte 0
_LENGTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)  # bytes of a character by its first


class Vocabulary:
    """Pieces as bytes, their log chances, and a tree of all their beginnings."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [b""] * size
        ranks = np.full(size, float(size))
        usable = []
        for i in range(size):
            if model.is_byte(i):
                self.pieces[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i] = model.id_to_piece(i).replace(_BLANK_PIECE, " ").encode()
                ranks[i] = -model.get_score(i)
                usable.append(i)
        mass = 1 / (ranks + 3)
        self.scores = np.log(mass / mass.sum())
        self.longest = max(len(self.pieces[i]) for i in usable)
        lengths = [len(p) for p in self.pieces]
        self.lengths = np.array(lengths)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self._grow({self.pieces[i]: i for i in usable})

    def _grow(self, whole: dict[bytes, int]) -> None:
        """The tree of all beginnings of pieces: inner nodes are numbered first and have a row of children by byte."""
        beginnings = sorted({p[:n] for p in whole for n in range(1, len(p) + 1)})
        inner = {b""} | {b[:-1] for b in beginnings}
        number = {b: i for i, b in enumerate([*sorted(inner), *(b for b in beginnings if b not in inner)])}
        self.inner = len(inner)
        self.children = np.full(self.inner << 8, -1, dtype=np.int32)
        self.ids = np.full(len(number), -1, dtype=np.int32)
        for b in beginnings:
            self.children[(number[b[:-1]] << 8) + b[-1]] = number[b]
        for b, i in whole.items():
            self.ids[number[b]] = i


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class Lattice:
    """Edges, side by side for each source node: length in bytes, piece, log chance and running chance; each node's first edge and the one after its last."""

    step: np.ndarray
    piece: np.ndarray
    logp: np.ndarray
    chance: np.ndarray
    running: np.ndarray
    first: np.ndarray
    last: np.ndarray


BLOCK = 1 << 17


def build_lattice(data: np.ndarray, stops: np.ndarray, vocab: Vocabulary) -> Lattice:
    """The lattice over bytes that fall into stretches with the given ends, a block of stretches at a time."""
    parts, lo, base, edges = [], 0, 0, 0
    while lo < len(stops):
        hi = max(lo + 1, int(np.searchsorted(stops, base + BLOCK)))
        size = int(stops[hi - 1]) - base
        end = np.repeat(stops[lo:hi] - base, np.diff(stops[lo:hi], prepend=base))
        step, piece, logp, first, degree = _edges(data[base : base + size], end, vocab)
        first += edges
        parts.append((step, piece, logp, first, first + degree))
        lo, base, edges = hi, base + size, edges + len(step)
    empty = (np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32), np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    step, piece, logp, first, last = (np.concatenate(x) for x in zip(empty, *parts, strict=True))
    chance = np.where(np.isfinite(logp), np.exp(logp), 0.0)
    running = np.zeros(edges + 1)
    np.cumsum(chance, out=running[1:])
    return Lattice(step, piece, logp, chance, running, first, last)


def _edges(data: np.ndarray, end: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """Length, piece and log chance of the edges, each node's first and their number; ``end`` is the end of each byte's stretch.

    Nodes nearest to their stretch's end come first, so that a level of the backward sums is a slice.
    """
    n = len(data)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    char = _LENGTH[data[starts]]
    char_at = np.zeros(n, dtype=np.int64)
    char_at[starts] = char
    single = np.zeros(n, dtype=bool)
    degree = np.zeros(n, dtype=np.int64)
    found = []
    at, node, left = starts, np.zeros(len(starts), dtype=np.int32), end[starts] - starts
    for size in range(1, vocab.longest + 1):
        on = np.flatnonzero((left >= size) & (node < vocab.inner))
        at, left = at[on], left[on]
        node = vocab.children[(node[on] << 8) + data[at + (size - 1)]]
        on = np.flatnonzero(node >= 0)
        if not len(on):
            break
        at, left, node = at[on], left[on], node[on]
        ids = vocab.ids[node]
        whole = np.flatnonzero(ids >= 0)
        source = at[whole]
        degree[source] += 1
        single[source[char_at[source] == size]] = True
        found.append((size, source, ids[whole]))
    spelled = starts[~single[starts]]
    lengths = np.minimum(char_at[spelled], end[spelled] - spelled)
    spelled = np.repeat(spelled - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    degree[spelled] += 1
    # Long pieces first within a node: they are the likelier, and the walk looks at edges in this order.
    nodes = np.flatnonzero(degree)
    depth = end[nodes] - nodes
    order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
    nodes, depth, many = nodes[order], depth[order], degree[nodes[order]]
    begins = np.concatenate([[0], np.cumsum(many)])
    first = np.zeros(n, dtype=np.int64)
    first[nodes] = begins[:-1]
    free = first.copy()
    step, piece = np.ones(begins[-1], dtype=np.int32), np.empty(begins[-1], dtype=np.int32)
    for size, source, ids in reversed(found):
        slot = free[source]
        step[slot], piece[slot] = size, ids
        free[source] = slot + 1
    piece[free[spelled]] = FIRST_BYTE + data[spelled]
    ahead = vocab.scores[piece]
    target = np.repeat(nodes, many) + step
    target[step == np.repeat(depth, many)] = n  # ends of stretches are one node, whose sum is none
    back = np.full(n + 1, -np.inf)
    back[n] = 0
    levels = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth))
    for lo, hi in zip(levels[:-1], levels[1:], strict=True):
        a, b = begins[lo], begins[hi]
        ahead[a:b] += back[target[a:b]]
        cut = begins[lo:hi] - a
        top = np.maximum.reduceat(ahead[a:b], cut)
        with np.errstate(invalid="ignore"):
            back[nodes[lo:hi]] = top + np.log(np.add.reduceat(np.exp(ahead[a:b] - np.repeat(top, many[lo:hi])), cut))
    ahead -= np.repeat(back[nodes], many)
    return step, piece, ahead, first, degree


def stream(keys: np.ndarray, path: int, use: int) -> np.ndarray:
    """What a row's random numbers for one path and purpose start from."""
    return mix(keys + np.uint64((path * 2 + use + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def uniform(streams: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) for bytes of rows."""
    h = place.astype(np.uint64)
    h *= np.uint64(0xD1B54A32D192ED03)
    h ^= streams
    h = mix(h)
    h >>= np.uint64(11)
    out = h.astype(np.float64)
    out += 0.5
    out /= 1 << 53
    return out


def _truncated(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of the given log masses, cut off at ``top``; minus infinity where there is no mass."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = mass - np.log(np.exp(mass - top) - np.log(u))
    return np.where(np.isfinite(mass), np.minimum(out, top), -np.inf)


@dataclass
class _Path:
    """One sampled path of every text that has one: places, edges, log chances, and the values of the sets beside it."""

    place: np.ndarray
    edge: np.ndarray
    begins: np.ndarray
    beside: np.ndarray
    log_prob: np.ndarray
    value: np.ndarray
    taken: list[tuple[int, ...]]


class Sampler:
    """Samples of all texts of one slab."""

    def __init__(self, slab: Slab, keys: np.ndarray, vocab: Vocabulary) -> None:
        self.vocab, self.keys = vocab, keys
        sizes = np.diff(slab.offsets)
        full = np.flatnonzero(sizes > 0)
        self.data = np.insert(slab.data, slab.offsets[:-1][full], SPACE)
        self.begins = slab.offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
        data, n = self.data, len(self.data)
        self.texts = len(sizes)
        self.text_of = np.repeat(np.arange(self.texts, dtype=np.int32), np.diff(self.begins))
        cut = np.zeros(n + 1, dtype=bool)
        if n:
            cut[1:n] = (data[1:] == SPACE) & (data[:-1] != SPACE)
        cut[self.begins] = True
        self.starts = np.flatnonzero(cut[:n])
        stops = np.append(self.starts[1:], n)
        self.stops = stops
        hashes = hash_spans(data, self.starts, stops)
        _, chosen, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (stops - self.starts)[chosen]
        self.kind_at = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(self.starts[chosen] - self.kind_at[:-1], lengths) + np.arange(lengths.sum())
        self.lattice = build_lattice(data[source], self.kind_at[1:], vocab)
        self.shift = self.kind_at[self.kind] - self.starts  # from a byte of the slab to its node

    def _walk(self, place: np.ndarray, unit: np.ndarray, path: int, edge_at: np.ndarray) -> None:
        """Draw edges from each place to the end of its unit, noting each at its place."""
        lat, streams = self.lattice, stream(self.keys, path, 0)
        while len(place):
            node = place + self.shift[unit]
            text = self.text_of[place]
            aim = uniform(streams[text], place - self.begins[text])  # a node's chances sum to one
            edge = lat.first[node]
            final = lat.last[node] - 1
            aim += lat.running[edge]
            late = np.flatnonzero(edge < final)
            late = late[lat.running[edge[late] + 1] <= aim[late]]
            at, aim, final = edge[late], aim[late], final[late]
            while len(late):
                at += 1
                edge[late] = at
                on = np.flatnonzero((lat.running[at + 1] <= aim) & (at < final))
                late, at, aim, final = late[on], at[on], aim[on], final[on]
            edge_at[place] = edge
            place = place + lat.step[edge]
            on = np.flatnonzero(place < self.stops[unit])
            place, unit = place[on], unit[on]

    def _path(self, edge_at: np.ndarray, path: int, value: np.ndarray, since: np.ndarray, taken: list[tuple[int, ...]]) -> _Path:
        """Note a path; ``since`` is the place from which it is its own, where ``taken`` edges are out already."""
        lat = self.lattice
        place = np.flatnonzero(edge_at >= 0).astype(np.int32)
        edge = edge_at[place]
        begins = np.searchsorted(place, self.begins)
        total = np.concatenate([[0.0], np.cumsum(lat.logp[edge])])
        first = total[begins[:-1]]
        gone = {}
        for i in np.flatnonzero([len(t) > 1 for t in taken]):
            j = begins[i] + np.searchsorted(place[begins[i] : begins[i + 1]], since[i])
            gone[int(j)] = sum(lat.chance[e] for e in taken[i])
        beside, streams = np.full(len(place), -np.inf), stream(self.keys, path, 1)
        own = np.flatnonzero(place >= since[self.text_of[place]])
        for lo in range(0, len(own), SLAB):
            part = own[lo : lo + SLAB]
            text, out = self.text_of[place[part]], lat.chance[edge[part]]
            for j, chance in gone.items():
                if part[0] <= j <= part[-1]:
                    out[np.searchsorted(part, j)] = chance
            with np.errstate(divide="ignore"):
                mass = total[part] - first[text] + np.log(np.where(out < 1 - 1e-12, 1 - out, 0.0))
            u = uniform(streams[text], place[part] - self.begins[text])
            beside[part] = _truncated(mass, value[text], u)
        return _Path(place, edge, begins, beside, total[begins[1:]] - first, value, taken)

    def sample(self, k: int) -> tuple[list[_Path], np.ndarray, np.ndarray]:
        """Up to k paths, which texts have the r-th (paths, texts), and each text's threshold."""
        n = len(self.data)
        edge_at = np.full(n, -1, dtype=np.int32)
        self._walk(self.starts, np.arange(len(self.starts)), 0, edge_at)
        value = -np.log(-np.log(uniform(stream(self.keys, 0, 1), np.zeros(self.texts))))
        paths = [self._path(edge_at, 0, value, self.begins[:-1], [()] * self.texts)]
        has = [np.ones(self.texts, dtype=bool)]
        threshold = np.full(self.texts, -np.inf)
        for r in range(1, k + 1):
            best, where = np.full(self.texts, -np.inf), np.zeros((self.texts, 2), dtype=np.int64)
            for p, path in enumerate(paths):
                filled = np.flatnonzero(np.diff(path.begins) > 0)
                if not len(filled):
                    continue
                tops = np.maximum.reduceat(path.beside, path.begins[:-1][filled])
                for i in filled[tops > best[filled]]:
                    a, b = path.begins[i], path.begins[i + 1]
                    j = a + int(path.beside[a:b].argmax())
                    best[i], where[i] = path.beside[j], (p, j)
            if r == k:
                threshold = best
                break
            go = np.isfinite(best) & has[-1]
            has.append(go)
            fresh = np.full(n, -1, dtype=np.int32)
            since, taken = np.full(self.texts, n), [()] * self.texts
            places, units = [], []
            chosen = np.flatnonzero(go)
            at = np.array([paths[p].place[j] for p, j in where[chosen]], dtype=np.int64)
            draws = dict(zip(chosen.tolist(), uniform(stream(self.keys[chosen], r, 0), at - self.begins[chosen]), strict=True))
            for i in chosen.tolist():
                p, j = where[i]
                path = paths[p]
                path.beside[j] = -np.inf
                place = int(path.place[j])
                out = path.taken[i] if path.taken[i] and path.edge[j] == path.taken[i][-1] and self._since[p][i] == place else (int(path.edge[j]),)
                a = path.begins[i]
                fresh[path.place[a:j]] = path.edge[a:j]
                unit = int(np.searchsorted(self.starts, place, side="right") - 1)
                edge = self._other(place + int(self.shift[unit]), draws[i], out)
                fresh[place] = edge
                since[i], taken[i] = place, (*out, edge)
                after = place + int(self.lattice.step[edge])
                if after < self.stops[unit]:
                    places.append(np.array([after]))
                    units.append(np.array([unit]))
                later = np.arange(unit + 1, np.searchsorted(self.starts, self.begins[i + 1]))
                places.append(self.starts[later])
                units.append(later)
            if places:
                self._walk(np.concatenate(places), np.concatenate(units), r, fresh)
            self._since[r] = since
            paths.append(self._path(fresh, r, best, since, taken))
        return paths, np.stack(has), threshold

    @functools.cached_property
    def _since(self) -> dict[int, np.ndarray]:
        return {0: self.begins[:-1]}

    def _other(self, node: int, u: float, out: tuple[int, ...]) -> int:
        """An edge of ``node`` that isn't ``out``, by chance."""
        first = int(self.lattice.first[node])
        chance = self.lattice.chance[first : int(self.lattice.last[node])].copy()
        chance[[e - first for e in out]] = 0.0
        below = chance.cumsum()
        return first + min(int(below.searchsorted(u * below[-1], side="right")), int(chance.nonzero()[0][-1]))


def decode_flat(ids: np.ndarray, begins: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of concatenated pieces, the blank before each text still there, and where each text's begin."""
    lengths = vocab.lengths[ids]
    places = np.concatenate([[0], np.cumsum(lengths)])
    source = np.repeat(vocab.starts[ids] - places[:-1], lengths) + np.arange(places[-1])
    return vocab.bytes[source], places[begins]


def _run_places(keys: np.ndarray, last: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """Of each key how many equal ones stand directly before it, and ``(key, place)`` to go on from."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    place = np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))
    if int(keys[0]) == last[0]:
        place[: new[1] if len(new) > 1 else len(keys)] += last[1] + 1
    return place, (int(keys[-1]), int(place[-1]))


def _encode(model_path: str, k: int, seed: int, repeats: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, last = vocabulary(model_path), (-1, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = mix(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(seed))
            if repeats:
                place, last = _run_places(keys, last)
                keys = np.where(place > 0, mix(keys + place.astype(np.uint64)), keys)
            for slab in slabs(batch.column("text"), SLAB):
                rows = len(slab.offsets) - 1
                sampler = Sampler(slab, keys[slab.first : slab.first + rows], vocab)
                paths, has, threshold = sampler.sample(k)
                ids = batch.column("id").slice(slab.first, rows)
                for r, path in enumerate(paths):
                    pieces = sampler.lattice.piece[path.edge]
                    data, begins = decode_flat(pieces, path.begins, vocab)
                    exact = np.array([np.array_equal(data[a:b], sampler.data[c:d]) for a, b, c, d in zip(begins[:-1], begins[1:], sampler.begins[:-1], sampler.begins[1:], strict=True)], dtype=bool)
                    gap = path.log_prob - threshold
                    with np.errstate(divide="ignore", over="ignore"):
                        inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
                    keep = pa.array(has[r])
                    table = pa.record_batch(
                        [
                            ids,
                            pa.array(np.full(rows, r + 1, dtype=np.int32)),
                            pa.ListArray.from_arrays(pa.array(path.begins.astype(np.int32)), pa.array(pieces.astype(np.int32))),
                            *(pa.array(np.round(x, 9)) for x in (path.log_prob, path.value, inclusion)),
                            pa.array(exact),
                        ],
                        names=["id", "sample", "pieces", "log_prob", "perturbed", "log_inclusion", "exact"],
                    )
                    yield table.filter(keep)
                del sampler, paths, path, table  # before the next slab's arrays are made

    return tidy(run)


def encode_samples(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", *, samples: int = 2, seed: int = 1, repeats: bool = False) -> DataFrame:
    """Return ``(id, sample, pieces, log_prob, perturbed, log_inclusion, exact)``, ``samples`` rows for each row of ``docs``.

    ``sample`` counts from 1 by falling perturbed value; segmentations of one text
    differ. A text with fewer segmentations has fewer rows. ``log_inclusion`` is
    the log chance to be in a sample with the text's threshold, and ``exact`` tells
    that the pieces decode to the text. A null or empty text has one sample without
    pieces. Scores are rounded to nine places, so that they don't tell how texts
    were batched. Rows that repeat an id draw the same numbers, unless ``repeats``: then a
    row directly after one of its id draws others. Rows without an id draw by their
    text. Other columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    key = F.when(F.col(id_column).isNull(), F.xxhash64(F.col(text_column))).otherwise(F.xxhash64(F.col(id_column)))
    rows = docs.select(F.col(id_column).alias("id"), key.alias("key"), F.col(text_column).alias("text"))
    schema = f"id {kind}, sample int, pieces array<int>, log_prob double, perturbed double, log_inclusion double, exact boolean"
    return rows.mapInArrow(_encode(model_path, samples, seed, repeats), schema).withColumnRenamed("id", id_column)


def decode_pieces(encoded: DataFrame, model_path: str, pieces_column: str = "pieces", out: str = "text") -> DataFrame:
    """Add the decoded text of ``pieces_column``; null pieces decode to null."""
    fields = T.StructType([*(f for f in encoded.schema if f.name != out), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = []
            for pieces in batch.column(pieces_column):
                texts.append(b"".join(vocab.pieces[i] for i in pieces.as_py()).decode(errors="replace")[1:] if pieces.is_valid else None)
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != out]
            names = [name for name in batch.schema.names if name != out]
            yield pa.record_batch([*columns, pa.array(texts, pa.string())], names=[*names, out])

    return encoded.mapInArrow(run, fields)
