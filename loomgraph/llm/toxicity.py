"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

``P(severity > k | x) = sigmoid(w . x - threshold_k)`` with one weight vector for all
ordered thresholds. Features are the presence of hashed words and of their
beginnings, which inflected forms of a word share. The fit is an
accelerated proximal gradient descent with an L1 penalty, in numpy, on a sample of
labelled rows that is bounded in rows and bytes, in one task of an executor; scoring is
one vectorised pass over all whole texts. A clean text is one without the marks of
the toxic class: features that mark clean rows get no weight.

The labels say toxic or not. Grades are drawn from them in the sample: rows
labelled clean are grade 0; the words that mark the toxic class (a high log odds
of presence) are counted in each toxic row, and the tertiles of that dose cut
toxic rows into grades 1 to 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import key_bitmap, with_membership
from loomgraph.llm.lexing import hash_spans, mix, owners, slabs, tidy
from loomgraph.storage import Scratch, bounded_batches, materialise

GRADES = 3


@dataclass(frozen=True)
class SeverityModel:
    """Sorted hashes of the features with a weight, their weights, the ordered thresholds, and the chance that rejects."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def over(self, margin: np.ndarray) -> np.ndarray:
        """``P(severity > k)`` for k = 0, 1, ...; a column each."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None, :], -40, 40)))


#: Lengths in bytes of the beginnings that count as features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slab: first row, rows, and (row, feature hash) for every word and beginning, repeats included."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for at in range(0, len(texts), 256):
        for slab in slabs(pc.utf8_lower(texts.slice(at, 256))):
            starts, ends = slab.word_spans(plain=True)
            begins = np.searchsorted(starts, slab.offsets)
            text = owners(begins, len(starts))
            rows = [text, *(text[ends - starts > k] for k in BEGINNINGS)]
            yield at + slab.first, len(begins) - 1, np.concatenate(rows), np.concatenate(hash_spans(slab.data, starts, ends, BEGINNINGS))


def _once(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs."""
    order = np.lexsort((words, rows))
    rows, words = rows[order], words[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])
    return rows[new], words[new]


def _grade(dose: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    cuts = np.quantile(dose[toxic], [1 / 3, 2 / 3]) if toxic.any() else [0, 0]
    return np.where(toxic, 1 + (dose > cuts[0]).astype(int) + (dose > cuts[1]).astype(int), 0)


#: Features are worth a weight when their log odds of presence in toxic rows are over this.
LEAST_ODDS = 1.2
FOLDS = 3


def _log_odds(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    return np.log((in_toxic + 0.5) / (toxic + 1)) - np.log((in_clean + 0.5) / (clean + 1))


def _single(column: pa.Array) -> np.ndarray:
    """Rows that are the first with their words: copies would pass for evidence."""
    sums = np.zeros(len(column), dtype=np.uint64)
    for first, size, rows, words in _features(column):
        order = np.argsort(rows, kind="stable")
        begins = np.searchsorted(rows[order], np.arange(size + 1))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words[order]))])
        sums[first : first + size] = total[begins[1:]] - total[begins[:-1]]
    chosen = np.zeros(len(column), dtype=bool)
    chosen[np.unique(sums, return_index=True)[1]] = True
    return chosen


def _counted(names: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *names]), return_inverse=True)
    return known, np.bincount(at, weights=np.concatenate([np.empty(0), *times]), minlength=len(known))


def _toxic_features(column: pa.Array, rows_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features of the toxic rows, and in how many of them each is."""
    names, times, held = [], [], 0
    for first, _, rows, words in _features(column):
        use = rows_in[first + rows]
        found, n = np.unique(_once(rows[use], words[use])[1], return_counts=True)
        names.append(found)
        times.append(n)
        held += len(found)
        if held > 1 << 21:
            merged = _counted(names, times)
            names, times, held = [merged[0]], [merged[1]], 0
    return _counted(names, times)


def _matches(column: pa.Array, names: np.ndarray, rows_in: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, place in names)`` of each distinct feature of the chosen rows, slab by slab."""
    for first, _, rows, words in _features(column):
        use = rows_in[first + rows]
        rows, words = _once(rows[use], words[use])
        at = np.minimum(np.searchsorted(names, words), max(0, len(names) - 1))
        hit = names[at] == words if len(names) else np.zeros(len(words), dtype=bool)
        yield first + rows[hit], at[hit]


def _descend(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, m: int, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``m`` features and ordered thresholds: accelerated proximal gradient steps on the cumulative-link likelihood."""
    n = len(grade)
    target = (grade[:, None] > np.arange(GRADES)[None, :]).astype(float)
    w, t = np.zeros(m), np.linspace(1.0, 3.0, GRADES)
    vw, vt, momentum = w.copy(), t.copy(), 1.0
    width = np.bincount(rows, minlength=n).max(initial=1)
    rate = 4.0 / (GRADES * (min(width, 60) + 1))
    for _ in range(steps):
        margin = np.bincount(rows, weights=vw[cols], minlength=n)
        miss = 1 / (1 + np.exp(-np.clip(margin[:, None] - vt[None, :], -40, 40))) - target
        gw = np.bincount(cols, weights=miss.sum(axis=1)[rows], minlength=m) / n
        new_w = vw - rate * gw * 40
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1 * 40, 0)
        new_t = np.sort(vt + rate * 40 * miss.mean(axis=0) * 0.2)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        vw, vt = new_w + pull * (new_w - w), new_t + pull * (new_t - t)
        w, t, momentum = new_w, new_t, following
    return w, t


def _chance(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """``P(severity > 0)`` of each row."""
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=n) - t[0], -40, 40)))


def fit_severity(texts: pa.Array | list[str | None], toxic: list[int], *, min_rows: int = 4, l1: float = 0.0004, steps: int = 400) -> SeverityModel:
    """Fit on labelled texts; a sample without both classes gives a model that calls nothing toxic.

    Features come from toxic rows, which they are to mark, and are counted exactly in
    both classes. The cut is set where rows, each scored by a model that has not seen
    it, are told apart with the least errors.
    """
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    y = np.asarray(toxic, dtype=int).astype(bool)
    chosen = _single(column)
    if not (y & chosen).any() or not (~y & chosen).any():
        return SeverityModel(np.empty(0, dtype=np.uint64), np.empty(0), np.full(GRADES, 40.0))
    names, in_toxic = _toxic_features(column, chosen & y)
    in_clean = np.zeros(len(names))
    for _, at in _matches(column, names, chosen & ~y):
        in_clean += np.bincount(at, minlength=len(names))
    odds = _log_odds(in_toxic, in_clean, (chosen & y).sum(), (chosen & ~y).sum())
    use = (in_toxic + in_clean >= min_rows) & (odds > LEAST_ODDS)
    names, odds = names[use], odds[use]
    found = list(_matches(column, names, chosen))
    rows, cols = (np.concatenate([np.empty(0, dtype=np.int64), *(x[k] for x in found)]) for k in (0, 1))
    rows, y = (np.cumsum(chosen) - 1)[rows], y[chosen]
    n, m = len(y), len(names)
    grade = _grade(np.bincount(rows, weights=(odds > 2.0)[cols], minlength=n), y)
    w, t = _descend(rows, cols, grade, m, l1, steps)
    # Each class is dealt to the folds in turn, so that every fold has both where it can.
    fold = np.zeros(n, dtype=np.int64)
    for part in (np.flatnonzero(y), np.flatnonzero(~y)):
        fold[part] = np.arange(len(part)) % FOLDS
    chance = np.zeros(n)
    for k in range(FOLDS):
        seen, place = fold != k, np.cumsum(fold != k) - 1
        pick = seen[rows]
        fw, ft = _descend(place[rows[pick]], cols[pick], grade[seen], m, l1, steps // 2) if y[seen].any() and not y[seen].all() else (w, t)
        chance[~seen] = _chance(rows, cols, fw, ft, n)[~seen]
    # A clean row rejected counts as three; the cut lies midway between two rows.
    order = np.argsort(chance, kind="stable")
    ranked, clean_above = chance[order], (~y).sum() - np.cumsum(~y[order])
    errors = 3 * clean_above + np.cumsum(y[order])
    best = int(np.argmin(errors[:-1])) if n > 1 else 0
    cut = float(np.clip((ranked[best] + ranked[min(best + 1, n - 1)]) / 2, 0.05, 0.5))
    on = w != 0
    return SeverityModel(names[on], w[on], t, cut)


def _fit(max_rows: int, max_bytes: int) -> Callable:
    """The model of the one partition of the sample, as a row of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, held = [], [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            fits = int(np.searchsorted(held + np.cumsum(sizes, dtype=np.int64), max_bytes, side="right"))
            fits = min(fits, max_rows - sum(map(len, texts)))
            texts.append(batch.column("text").slice(0, fits))
            labels += batch.column("label").slice(0, fits).to_pylist()
            held += int(sizes[:fits].sum())
            if fits < batch.num_rows:
                break
        m = fit_severity(pa.chunked_array(texts, pa.string()).combine_chunks(), labels)
        parts = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((m.words, np.uint64), (m.weights, np.float64), (m.thresholds, np.float64))]
        yield pa.record_batch([*parts, pa.array([m.cut])], names=["words", "weights", "thresholds", "cut"])

    return tidy(run)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = 8000) -> DataFrame:
    """``(place, id, text, label)`` of at most ``max_rows`` labelled rows, chosen and placed by a hash of the id.

    An id that has several rows gives one, that of the least text; ids and labels that are null give none.
    """
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    picked = known.select("id", "label", F.xxhash64("id").alias("place")).orderBy("place", "id").limit(max_rows)
    picked = materialise(picked, "labelled")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    near = with_membership(texts, ["id"], key_bitmap(picked, ["id"]), "__lg_maybe").where("__lg_maybe")
    return near.join(picked, "id").groupBy("place", "id", "label").agg(F.min("text").alias("text"))


def fitted_severity(sample: DataFrame, *, max_rows: int = 8000, max_bytes: int = 1 << 26) -> SeverityModel:
    """Fit in one task on the first ``max_rows`` rows and ``max_bytes`` bytes of the sample; only the weights reach the driver."""
    bounded_batches(sample.sparkSession)
    inside = sample.repartition(1).sortWithinPartitions("place", "id").select("text", "label")
    row = inside.mapInArrow(_fit(max_rows, max_bytes), "words binary, weights binary, thresholds binary, cut double").first()
    if row is None:  # no partition at all
        return fit_severity([], [])
    return SeverityModel(*(np.frombuffer(row[k], dtype=kind) for k, kind in (("words", np.uint64), ("weights", np.float64), ("thresholds", np.float64))), row.cut)


def _scores(m: SeverityModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected severity, likeliest grade and ``P(severity > 0)`` of each text."""
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[m.words >> np.uint64(48)] = True
    expected, grade, chance = [np.empty(0)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
    for _, n, rows, words in _features(texts):
        near = maybe[words >> np.uint64(48)]
        rows, words = _once(rows[near], words[near])
        at = np.searchsorted(m.words, words)
        hit = at < len(m.words)
        hit[hit] = m.words[at[hit]] == words[hit]
        over = m.over(np.bincount(rows[hit], weights=m.weights[at[hit]], minlength=n))
        expected.append(over.sum(axis=1))
        chance.append(over[:, 0])
        each = np.column_stack([1 - over[:, 0], over[:, :-1] - over[:, 1:], over[:, -1]])
        grade.append(each.argmax(axis=1))
    return np.concatenate(expected), np.concatenate(grade), np.concatenate(chance)


def _score(model: SeverityModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), *map(pa.array, _scores(model, batch.column("text")))], names=["id", "expected_severity", "severity", "p_toxic"])

    return tidy(run)


def _civil(model: SeverityModel, text_column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(text_column))[2] < model.cut))

    return tidy(run)


def score_severity(docs: DataFrame, model: SeverityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return ``(id, expected_severity, severity, p_toxic, toxic, kept)``, a row for each row of ``docs``.

    ``severity`` is the likeliest grade, 0 (clean) to 3. ``toxic`` is
    ``p_toxic >= model.cut``, at most a half, and ``kept`` its contrary. A null or empty text has no words and so the score of
    the thresholds alone. Rows that repeat an id are scored one by one; a null id
    stays null. Other columns are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    scored = rows.mapInArrow(_score(model), f"id {kind}, expected_severity double, severity long, p_toxic double")
    return scored.withColumn("toxic", F.col("p_toxic") >= model.cut).withColumn("kept", ~F.col("toxic")).withColumnRenamed("id", id_column)


def severity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, label_column: str = "toxic", max_rows: int = 8000, max_bytes: int = 1 << 26
) -> DataFrame:
    """Fit on the labelled part of ``docs``, at most ``max_rows`` rows and ``max_bytes`` of text, and score all of it."""
    with Scratch(docs.sparkSession):
        sample = labelled_sample(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column, max_rows=max_rows)
        model = fitted_severity(sample, max_rows=max_rows, max_bytes=max_bytes)
    return score_severity(docs, model, id_column, text_column)


def keep_civil(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, label_column: str = "toxic", max_rows: int = 8000, max_bytes: int = 1 << 26) -> DataFrame:
    """``docs`` less the rows that ``severity`` calls toxic; all columns as they were.

    Rows are judged one by one where they stand: no id is joined, so null and repeated
    ids make no difference. A null or empty text stays.
    """
    with Scratch(docs.sparkSession):
        sample = labelled_sample(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column, max_rows=max_rows)
        model = fitted_severity(sample, max_rows=max_rows, max_bytes=max_bytes)
    return docs.mapInArrow(_civil(model, text_column), docs.schema)
