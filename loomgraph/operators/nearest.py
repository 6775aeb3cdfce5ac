"""The nearest rows of each row by cosine: exact, by matrix products of packed blocks.

Vectors are packed into blocks of some thousand rows. Every block of queries meets every
block of vectors that may hold a row of one of its groups, and a task keeps the ``k`` best of
each query as it goes, so what leaves it is ``k`` rows a query and not the pairs. Products
in single precision only say which pairs may be among the best: their error is
bounded, and each pair within the bound is scored again in double precision, component after
component, as ``functions.vector`` does. Of equal vectors of a block only as many as can
be among the best are kept, so a large group of copies doesn't multiply.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import bounded_batches, materialise

#: Rows of a block, bytes of its vectors, and rows that one task packs.
PACK, PACK_BYTES, TASK_ROWS = 4096, 8 << 20, 16384
#: Queries of a block that are multiplied at once.
STRIP = 256
#: The key of a score that is null, after all others, and of a place that is empty.
NULL, EMPTY = -1e300, -np.inf

_FIELDS = "pack long, lo string, hi string, dim int, n binary, first binary, vectors binary, labels array<string>, starts array<int>"


def _packs(copies: int | None):
    """Blocks of rows ``(n, label, vector)`` in order of label and n; of equal vectors of a label the first ``copies``, if given."""

    def block(number: int, n: np.ndarray, label: list[str], v: np.ndarray) -> dict:
        starts = [i for i in range(len(label)) if not i or label[i] != label[i - 1]]
        ns, vs, size, at = [], [], [], [0]
        for a, b in zip(starts, [*starts[1:], len(label)], strict=True):
            if copies is None:
                ns.append(n[a:b])
                vs.append(v[a:b])
                size.append(np.ones(b - a, np.int64))
            else:
                rows = np.ascontiguousarray(v[a:b])
                same = rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel() if rows.shape[1] else np.zeros(b - a)
                _, one, group = np.unique(same, return_index=True, return_inverse=True)
                order = np.argsort(group, kind="stable")
                held = np.bincount(group)
                place = np.arange(b - a) - np.repeat(np.cumsum(held) - held, held)
                ns.append(n[a:b][order][place < copies])
                vs.append(rows[one])
                size.append(np.minimum(held, copies))
            at.append(at[-1] + len(vs[-1]))
        first = np.concatenate([[0], np.cumsum(np.concatenate(size))])
        return {
            "pack": number, "lo": label[0], "hi": label[-1], "dim": v.shape[1] if v.shape[1] else -1, "n": np.concatenate(ns).astype(np.int64).tobytes(),
            "first": first.astype(np.int64).tobytes(), "vectors": np.concatenate(vs).astype(np.float64).tobytes(), "labels": [label[i] for i in starts], "starts": at,
        }

    kind = pa.schema([("pack", pa.int64()), ("lo", pa.string()), ("hi", pa.string()), ("dim", pa.int32()), ("n", pa.binary()), ("first", pa.binary()), ("vectors", pa.binary()), ("labels", pa.list_(pa.string())), ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}  # by length of the vectors; 0 for what has no score
        for batch in batches:
            n, label, column = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat, begin = column.flatten(), np.cumsum(length) - length
            if flat.null_count:
                gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
                length = np.where(gaps[begin + length] > gaps[begin], 0, length)
            values = flat.fill_null(0.0).to_numpy()
            for dim in np.unique(length).tolist():
                rows = np.flatnonzero(length == dim)
                of = waiting.setdefault(dim, [np.empty(0, np.int64), [], np.empty((0, dim))])
                of[0], of[1] = np.concatenate([of[0], n[rows]]), of[1] + [label[i] for i in rows]
                of[2] = np.concatenate([of[2], values[begin[rows][:, None] + np.arange(dim)]])
                most = max(1, min(PACK, PACK_BYTES // (8 * dim or 1)))
                while len(of[0]) >= most:
                    yield pa.RecordBatch.from_pylist([block(number, of[0][:most], of[1][:most], of[2][:most])], schema=kind)
                    number += 1
                    of[0], of[1], of[2] = of[0][most:], of[1][most:], of[2][most:]
        for of in waiting.values():
            if len(of[0]):
                yield pa.RecordBatch.from_pylist([block(number, *of)], schema=kind)
                number += 1

    return run


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` with that of ``b``, summed from the first component to the last."""
    out, products = np.zeros(len(a)), a * b
    for j in range(a.shape[1]):
        out += products[:, j]
    return out


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``round(x, digits)`` of Spark in units of its last digit."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    out = np.copysign(whole + (scaled - whole >= 0.5), x)
    for i in np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).scaleb(digits))
    return out


class _Block:
    """A block as it is read back. ``odd`` rows are too large, too small or not finite: no product says how near they are."""

    def __init__(self, row: dict, side: str, cosine: bool) -> None:
        dim = row[side + "dim"]
        self.n, self.first = np.frombuffer(row[side + "n"], np.int64), np.frombuffer(row[side + "first"], np.int64)
        self.dim, self.labels, self.starts = dim, row[side + "labels"], row[side + "starts"]
        if dim > 0:
            self.v = np.frombuffer(row[side + "vectors"], np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                size = np.sqrt(dots(self.v, self.v))
                self.size = size if cosine else np.ones(len(size))
                self.zero = size == 0
                self.odd = ~((size > 1e-100) & (size < 1e100)) & ~self.zero
                self.near = np.where((self.odd | self.zero)[:, None], 0, self.v / np.where(self.zero, 1, self.size)[:, None]).astype(np.float32)


class _Best:
    """The ``k`` best of each query of a block so far."""

    def __init__(self, q: _Block, k: int, least: float | None, cosine: bool, digits: int | None) -> None:
        self.q, self.k, self.least, self.cosine, self.digits = q, k, least, cosine, digits
        self.unit = 1.0 if digits is None else 10.0**-digits
        self.key, self.score, self.n = np.full((len(q.n), k), EMPTY), np.full((len(q.n), k), np.nan), np.full((len(q.n), k), -1)

    def meet(self, v: _Block) -> None:
        if self.q.dim != v.dim or v.dim < 0:
            if self.least is None:  # no score, but rows still
                few = np.sort(v.n)[: self.k + 1]
                rows = np.flatnonzero(self.key[:, -1] <= NULL)
                self.put(np.repeat(rows, len(few)), np.full(len(rows) * len(few), NULL), np.full(len(rows) * len(few), np.nan), np.tile(few, len(rows)))
            return
        at = {x: i for i, x in enumerate(v.labels)}
        for i, x in enumerate(self.q.labels):
            if x in at:
                for a in range(self.q.starts[i], self.q.starts[i + 1], STRIP):
                    self.strip(v, a, min(a + STRIP, self.q.starts[i + 1]), v.starts[at[x]], v.starts[at[x] + 1])

    def strip(self, v: _Block, a: int, b: int, c: int, d: int) -> None:
        q, k = self.q, self.k
        near = q.near[a:b] @ v.near[c:d].T
        error = (q.dim + 8) * 1.2e-7
        out = v.zero[c:d] & self.cosine | v.odd[c:d]
        near[:, out] = -4
        bound = self.key[a:b, -1] * self.unit - self.unit * (self.digits is not None) - error
        short = np.flatnonzero(self.key[a:b, -1] <= NULL)
        bound[short] = -np.inf
        if len(short) and d - c > k + 1:  # one of the best may be the query itself
            bound[short] = np.partition(near[short], d - c - k - 1, axis=1)[:, d - c - k - 1] - 2 * error
            if self.digits is not None:
                bound[short] -= self.unit
            bound[short[bound[short] < -3]] = -np.inf
        if self.least is not None:
            bound = np.maximum(bound, self.least - error)
        bound[q.odd[a:b] | q.zero[a:b] & self.cosine] = -np.inf
        near[:, v.odd[c:d]] = 4
        found = near >= np.where(np.isfinite(bound), bound, -5)[:, None].astype(np.float32)
        # A bound that is rounded up to single precision moves by less than the error it has.
        i, j = np.divmod(np.flatnonzero(found), d - c)
        i, j = i + a, j + c
        step = max(1, 4_000_000 // q.dim)
        for lo in range(0, len(i), step):
            self.score_pairs(v, i[lo : lo + step], j[lo : lo + step])

    def score_pairs(self, v: _Block, i: np.ndarray, j: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            score = dots(self.q.v[i], v.v[j])
            size = self.q.size[i] * v.size[j]
            none = size <= 0
            score = np.where(none, np.nan, score / np.where(none, 1, size))
            if self.least is not None:
                some = ~(score < self.least) & ~none
                i, j, score, none = i[some], j[some], score[some], none[some]
            key = np.where(none, NULL, np.where(np.isnan(score), np.inf, score))
            real = np.flatnonzero(~np.isnan(score))
            if self.digits is not None:
                key[real] = _half_up(score[real], self.digits)
        times = v.first[j + 1] - v.first[j]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.put(np.repeat(i, times), np.repeat(key, times), np.repeat(score, times), v.n[np.repeat(v.first[j], times) + place])

    def put(self, i: np.ndarray, key: np.ndarray, score: np.ndarray, n: np.ndarray) -> None:
        other = (n != self.q.n[i]) & (key >= self.key[i, -1])
        i, key, score, n = i[other], key[other], score[other], n[other]
        if not len(i):
            return
        rows, k = np.unique(i), self.k
        i, key = np.concatenate([np.repeat(rows, k), i]), np.concatenate([self.key[rows].ravel(), key])
        score, n = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.n[rows].ravel(), n])
        order = np.lexsort((n, -key, i))
        i, key, score, n = i[order], key[order], score[order], n[order]
        begin = np.searchsorted(i, rows)
        take = begin[:, None] + np.arange(k)
        self.key[rows], self.score[rows], self.n[rows] = key[take], score[take], n[take]

    def rows(self) -> pa.RecordBatch:
        full = self.key > EMPTY
        score = pa.array(self.score[full], mask=self.key[full] == NULL, from_pandas=False)
        return pa.record_batch([pa.array(np.repeat(self.q.n, self.k).reshape(full.shape)[full]), pa.array(self.n[full]), score], names=["q", "n", "score"])


def _meetings(k: int, least: float | None, cosine: bool, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["q_pack"] != now:
                    if best is not None:
                        yield best.rows()
                    now, best = row["q_pack"], _Best(_Block(row, "q_", cosine), k, least, cosine, digits)
                best.meet(_Block(row, "v_", cosine))
        if best is not None:
            yield best.rows()

    return run


def _packed(rows: DataFrame, copies: int | None) -> tuple[DataFrame, int]:
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    ordered = rows.repartitionByRange(tasks, "label", "n").sortWithinPartitions("label", "n")
    packs = materialise(ordered.mapInArrow(_packs(copies), _FIELDS), "packs")
    return packs, max(1, packs.count())


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, least: float | None = None, cosine: bool = True, digits: int | None = None) -> DataFrame:
    """``(q, n, score)``: of each query the ``k`` rows of its label with the highest score and another ``n``, and some more.

    Both tables are ``(n long, label string, vector array<double>)`` without null ``n`` or label. The score is the cosine, or
    the product where ``cosine`` is off and vectors are of length 1; it is rounded to ``digits``, if given, before it is
    compared, and equal scores are in order of ``n``. A null score comes last, and not at
    all where ``least`` is given, the lowest score that counts. Every task returns its own ``k`` best, so
    they are to be ranked once more.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    (x, many), (y, more) = _packed(queries, None), _packed(vectors, k + 1)
    tasks = max(16, 4 * spark.sparkContext.defaultParallelism)
    left = min(many, max(int(np.ceil(np.sqrt(tasks))), -(-many // 256)))
    right = min(more, max(-(-tasks // left), -(-more // 64)))
    x = x.repartition(left).select([F.col(c).alias(f"q_{c}") for c in x.columns]).hint("shuffle_replicate_nl")
    y = y.repartition(right).select([F.col(c).alias(f"v_{c}") for c in y.columns])
    pairs = x.join(y, (F.col("q_lo") <= F.col("v_hi")) & (F.col("v_lo") <= F.col("q_hi")))
    return pairs.mapInArrow(_meetings(k, least, cosine, digits), "q long, n long, score double")


def numbered(ids: DataFrame) -> DataFrame:
    """``(id, n)`` of the distinct values of the only column: whole numbers are their own ``n``, others are numbered in their order."""
    name = ids.columns[0]
    ids = ids.where(F.col(name).isNotNull()).distinct()
    if ids.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return ids.withColumn("n", F.col(name).cast("long"))
    ids = materialise(ids, "ids")
    ordered = ids.repartitionByRange(max(1, -(-ids.count() // 1_000_000)), name).sortWithinPartitions(name)
    return materialise(ordered.withColumn("n", F.monotonically_increasing_id()), "numbers")


def with_number(rows: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """``rows`` with the ``n`` of their ``key``, those without a key dropped."""
    if rows.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return rows.where(F.col(key).isNotNull()).withColumn("n", F.col(key).cast("long"))
    return rows.join(numbers.withColumnRenamed(numbers.columns[0], key), key)


def with_key(rows: DataFrame, n: str, key: str, numbers: DataFrame) -> DataFrame:
    """``rows`` with the ``key`` of their number, which goes."""
    kind = numbers.schema[numbers.columns[0]].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn(key, F.col(n).cast(kind)).drop(n)
    return rows.join(numbers.select(F.col(numbers.columns[0]).alias(key), F.col("n").alias(n)), n).drop(n)
