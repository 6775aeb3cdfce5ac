"""Personal data: fixed patterns, and a character-level BiLSTM-CRF beside them.

A byte mask finds the characters that every kind needs, a digit or ``@``. A model
span without them is dropped (``plausible``), so a text without one is settled, and the
tagger reads the neighbourhoods of these characters: regions of text around them, of
the length of any kind's longest part beside its last digit, cut into overlapping
windows; a test compares this with tagging whole texts. Window outputs are reconciled
by the middle of each window having most weight, and a Viterbi pass decodes the region.
A very long region is decoded in overlapping stretches that are joined where both say
that no entity is, so memory is bounded whatever the length of a text.

The tagger is trained in numpy, once for a process, on seeded examples with
labelled spans: invented words around generated personal data, and numbers,
versions, keys and dates that are none.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.lexing import slabs
from loomgraph.storage import bounded_batches

KINDS = ("email", "ip", "card", "phone")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    """Whether digits, however many, are a number up to 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, each found from its ``@``: to the left the run of local characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, stop, kind)`` of the fixed patterns, by kind as listed, then start."""
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m.group()))
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return found


# The tagger: characters fold into a small alphabet.
_ALPHABET = "\0 \n.,:;=@+-()_/%\"'aeiou0123456789ABC"
_LETTER, _CAPITAL, _OTHER = len(_ALPHABET), len(_ALPHABET) + 1, len(_ALPHABET) + 2
_SYMBOLS = len(_ALPHABET) + 3
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WIDTH, STEP, MARGIN = 64, 32, 24


def _fold(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    table = np.full(128, _OTHER, dtype=np.uint8)
    table[[*range(97, 123)]], table[[*range(65, 91)]] = _LETTER, _CAPITAL
    for i, c in enumerate(_ALPHABET[:-3]):
        table[ord(c)] = i
    return np.where(codes < 128, table[np.minimum(codes, 127)], np.uint8(_LETTER))


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Log scores of forbidden steps and starts: inside follows its begin or itself."""
    step, start = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        start[inside] = -1e4
        step[[t for t in range(TAGS) if t not in (inside, inside - 1)], inside] = -1e4
    return step, start


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, p: dict, side: str) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, units) of one direction, and what its backward pass needs."""
    n = p[f"u{side}"].shape[0]
    h, c = np.zeros((x.shape[1], n), dtype=np.float32), np.zeros((x.shape[1], n), dtype=np.float32)
    pre, out, kept = x @ p[f"w{side}"] + p[f"b{side}"], np.empty((*x.shape[:2], n), dtype=np.float32), []
    for t in range(len(x)):
        z = pre[t] + h @ p[f"u{side}"]
        gates, new = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        before, c = c, f * c + i * new
        tc = np.tanh(c)
        kept.append((i, f, o, new, before, tc, h))
        h = o * tc
        out[t] = h
    return out, kept


def _lstm_back(dout: np.ndarray, x: np.ndarray, kept: list, p: dict, side: str, g: dict) -> np.ndarray:
    u = p[f"u{side}"]
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dz = np.empty((*x.shape[:2], u.shape[1]), dtype=np.float32)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, new, before, tc, hb = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        g[f"u{side}"] += hb.T @ dz[t]
        dh, dc = dz[t] @ u.T, dc * f
    g[f"w{side}"] += np.einsum("tbi,tbj->ij", x, dz)
    g[f"b{side}"] += dz.sum(axis=(0, 1))
    return dz @ p[f"w{side}"].T


def emissions(p: dict, codes: np.ndarray) -> np.ndarray:
    """Tag scores (time, batch, tags) of windows of folded characters (time, batch)."""
    x = p["e"][codes]
    left, right = _lstm(x, p, "f")[0], _lstm(x[::-1], p, "r")[0][::-1]
    return np.concatenate([left, right], axis=2) @ p["o"] + p["c"]


def _crf_grad(scores: np.ndarray, tags: np.ndarray, trans: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the tags, and its gradients by scores and transitions."""
    n, b, k = scores.shape
    full = trans + step
    top = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    alpha, beta = np.empty((n, b, k)), np.zeros((n, b, k))
    alpha[0] = scores[0] + start
    for t in range(1, n):
        alpha[t] = top(alpha[t - 1][:, :, None] + full[None], 1) + scores[t]
    for t in range(n - 2, -1, -1):
        beta[t] = top(full[None] + (beta[t + 1] + scores[t + 1])[:, None, :], 2)
    z = top(alpha[-1], 1)
    ds = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1][..., None] + full + (beta[1:] + scores[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
    gold = np.eye(k)[tags]
    seen = np.einsum("tbi,tbj->ij", gold[:-1], gold[1:])
    loss = z.sum() - (gold * scores).sum() - (seen * full).sum()
    return loss / b, ((ds - gold) / b).astype(np.float32), (pair - seen) / b


_SOUNDS = np.array(list("aeionrsthld"))


def training_example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A line of invented words with personal data at known places, or look-alikes that are none."""
    word = lambda: "".join(_SOUNDS[rng.integers(0, len(_SOUNDS), rng.integers(2, 9))])
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    text, spans = "", []
    for _ in range(rng.integers(3, 6)):
        text += " ".join(word() for _ in range(rng.integers(1, 4)))
        text += rng.choice([" ", " ", " ", ": ", ", "])
        kind = rng.integers(0, 11)
        sep = rng.choice(["", "", " ", "-"])
        host = f"{word()}{rng.choice(['', number(1)])}.{rng.choice(['com', 'org', 'net', 'example.com', 'io'])}"
        made = {
            0: f"{word()}{rng.choice(['.', '_', ''])}{rng.choice([number(2), word()])}@{host}",
            1: ".".join(str(x) for x in rng.integers(0, 256, 4)),
            2: sep.join(number(4) for _ in range(4)),
            3: rng.choice([f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(7)}", f"({number(3)}) {number(3)}-{number(4)}", f"+{number(11)}"]),
            4: f"{rng.integers(0, 20)}.{rng.integers(0, 20)}{rng.choice(['', '.' + number(1)])}",
            5: number(rng.integers(1, 7)),
            6: rng.choice(["version ", "v"]) + number(1) + "." + number(1),
            7: 'token = "' + "".join(rng.choice(list("0123456789abcdef"), rng.integers(16, 40))) + '"',
            8: f"20{number(2)}-{number(2)}-{number(2)}",
            9: f"{rng.choice(['$', ''])}{number(3)},{number(3)}",
            10: rng.choice(["@" + word(), word() + number(2)]),
        }[int(kind)]
        if kind < 4:
            spans.append((len(text), len(text) + len(made), KINDS[kind]))
        text += str(made) + rng.choice([" ", ", ", ". ", "\n"])
    return text, spans


def _tags(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(length, dtype=np.int64)
    for a, b, kind in spans:
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] -= 1
    return out


@functools.lru_cache(maxsize=2)
def train_tagger(seed: int = 7, rounds: int = 220, batch: int = 32, units: int = 20, examples: int = 700) -> dict:
    """Parameters after Adam steps on the CRF likelihood of random windows of training examples."""
    rng = np.random.default_rng(seed)
    pool = [(text, _fold(text), _tags(len(text), spans)) for text, spans in (training_example(rng) for _ in range(examples))]
    size, emb = units, 12
    shape = {"e": (_SYMBOLS, emb), "o": (2 * size, TAGS), "c": (TAGS,), "t": (TAGS, TAGS)}
    for side in "fr":
        shape |= {f"w{side}": (emb, 4 * size), f"u{side}": (size, 4 * size), f"b{side}": (4 * size,)}
    p = {k: (rng.normal(0, 0.25, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    for side in "fr":
        p[f"b{side}"][size : 2 * size] = 1
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step, start = _allowed()
    for r in range(1, rounds + 1):
        codes, tags = np.zeros((WIDTH, batch), dtype=np.int64), np.zeros((WIDTH, batch), dtype=np.int64)
        for j in range(batch):
            text, folded, whole = pool[int(rng.integers(0, examples))]
            at = int(rng.integers(0, max(1, len(text) - WIDTH // 2)))
            part = whole[at : at + WIDTH]
            if len(part) and part[0] and part[0] % 2 == 0:
                part = part.copy()
                part[0] -= 1
            codes[: len(part), j], tags[: len(part), j] = folded[at : at + WIDTH], part
        x = p["e"][codes]
        (hf, kf), (hr, kr) = _lstm(x, p, "f"), _lstm(x[::-1], p, "r")
        both = np.concatenate([hf, hr[::-1]], axis=2)
        _, ds, dt = _crf_grad((both @ p["o"] + p["c"]).astype(np.float64), tags, p["t"].astype(np.float64), step, start)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["t"] = dt.astype(np.float32)
        g["o"], g["c"] = np.einsum("tbi,tbj->ij", both, ds), ds.sum(axis=(0, 1))
        dboth = ds @ p["o"].T
        dx = _lstm_back(dboth[:, :, :size], x, kf, p, "f", g) + _lstm_back(dboth[::-1, :, size:], x[::-1], kr, p, "r", g)[::-1]
        np.add.at(g["e"], codes.ravel(), dx.reshape(-1, emb))
        rate = 0.02 * min(1.0, 2 * (1 - r / (rounds + 1)))
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            p[k] -= (rate * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-6)).astype(np.float32)
    return p


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags of one region (time, tags)."""
    step, start = _allowed()
    full, best, back = trans + step, scores[0] + start, []
    for row in scores[1:]:
        paths = best[:, None] + full
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


def regions(triggers: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Neighbourhoods of sorted trigger places, joined where they meet."""
    if not len(triggers):
        return []
    cut = np.flatnonzero(np.diff(triggers) > 2 * MARGIN)
    starts, stops = triggers[np.append(0, cut + 1)] - MARGIN, triggers[np.append(cut, len(triggers) - 1)] + MARGIN + 1
    return list(zip(np.maximum(starts, 0).tolist(), np.minimum(stops, length).tolist(), strict=True))


_CENTRE = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float64)
STRETCH, OVERLAP, BATCH = 4096, 256, 1024


def stretches(a: int, b: int) -> list[tuple[int, int]]:
    """A region as one stretch, or several that overlap if it is long."""
    starts = range(a, max(a + 1, b - OVERLAP), STRETCH - OVERLAP)
    return [(s, min(b, s + STRETCH)) for s in starts]


def _decoded(jobs: list[tuple], windows: list[np.ndarray], p: dict) -> Iterator[np.ndarray]:
    """The best tags of each stretch ``(start, stop, window starts, first window)``."""
    scored = np.concatenate([emissions(p, np.stack(windows[k : k + 256], axis=1)) for k in range(0, len(windows), 256)], axis=1)
    for a, b, at, k in jobs:
        total, weight = np.zeros((b - a, TAGS)), np.zeros((b - a, 1))
        for j, s in enumerate(at):
            n = min(WIDTH, b - s)
            total[s - a : s - a + n] += scored[:n, k + j] * _CENTRE[:n, None]
            weight[s - a : s - a + n] += _CENTRE[:n, None]
        yield viterbi(total / weight, p["t"].astype(np.float64))


def _tagged(texts: list[str], p: dict, whole: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(text, start, tags)`` of each stretch, in order; a bounded number of windows at a time."""
    jobs, owner, windows = [], [], []
    for i, text in enumerate(texts):
        codes = _fold(text)
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        triggers = np.flatnonzero(((chars >= 48) & (chars <= 57)) | (chars == 64))
        found = [(0, len(text))] if whole and text else regions(triggers, len(text))
        for a, b in (part for region in found for part in stretches(*region)):
            at = list(range(a, max(a + 1, b - WIDTH + STEP), STEP))
            jobs.append((a, b, at, len(windows)))
            owner.append(i)
            for s in at:
                part = codes[s : min(s + WIDTH, b)]
                windows.append(np.pad(part, (0, WIDTH - len(part))))
            if len(windows) >= BATCH:
                yield from ((o, job[0], tags) for o, job, tags in zip(owner, jobs, _decoded(jobs, windows, p), strict=True))
                jobs, owner, windows = [], [], []
    if jobs:
        yield from ((o, job[0], tags) for o, job, tags in zip(owner, jobs, _decoded(jobs, windows, p), strict=True))


def tag_texts(texts: list[str], p: dict, whole: bool = False) -> list[list[tuple[int, int, str]]]:
    """Model spans of each text; ``whole`` tags all of it and not only the neighbourhoods of digits and ``@``."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]

    def note(i: int, a: int, tags: np.ndarray) -> None:
        for s in np.flatnonzero(tags % 2 == 1):
            e = s + 1
            while e < len(tags) and tags[e] == tags[s] + 1:
                e += 1
            found[i].append((a + int(s), a + int(e), KINDS[tags[s] // 2]))

    held: tuple[int, int, np.ndarray] | None = None
    for i, a, tags in _tagged(texts, p, whole):
        if held and held[0] == i and held[1] + len(held[2]) > a:  # the stretch before overlaps this one
            low, before = a - held[1], held[2]
            clear = np.flatnonzero((before[low:] == 0) & (tags[: len(before) - low] == 0))
            cut = int(clear[np.abs(clear - OVERLAP // 2).argmin()]) if len(clear) else OVERLAP // 2
            note(i, held[1], before[: low + cut])
            a, tags = a + cut, tags[cut:]
        elif held:
            note(*held)
        held = (i, a, tags)
    if held:
        note(*held)
    return found


_NUMBER = re.compile(r"[+(]{0,2}[0-9][0-9\x20().-]*[0-9]")


def plausible(text: str, start: int, stop: int, kind: str) -> bool:
    """Whether a model span has what its kind can't do without, and stands apart from what is beside it."""
    part, beside = text[start:stop], text[max(0, start - 1) : start] + text[stop : stop + 1]
    digits = sum(map(len, _DIGITS.findall(part)))
    if kind == "email":
        return "@" in part[1:-3] and "." in part.rpartition("@")[2][1:-1]
    if any(c.isalnum() for c in beside) or not _NUMBER.fullmatch(part):
        return False
    if kind == "ip":
        return part.count(".") == 3 and 4 <= digits <= 12
    return 13 <= digits <= 19 and len(part) <= 24 if kind == "card" else 9 <= digits <= 15 and len(part) <= 22


def apart(spans: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of the others."""
    starts: list[int] = []
    stops: list[int] = []
    for start, stop, _ in sorted(others):
        if starts and start <= stops[-1]:
            stops[-1] = max(stops[-1], stop)
        else:
            starts.append(start)
            stops.append(stop)
    out = []
    for span in spans:
        k = bisect_left(starts, span[1]) - 1  # the last that begins before the span's end
        if k < 0 or stops[k] <= span[0]:
            out.append(span)
    return out


def find_personal(texts: list[str], p: dict) -> list[tuple[list, list]]:
    """Of each text the base spans, and all spans: the model's are added where no base span lies."""
    out = []
    for text, tagged in zip(texts, tag_texts(texts, p), strict=True):
        base = base_spans(text)
        added = apart([s for s in tagged if plausible(text, *s)], base)
        out.append((base, sorted(base + added, key=lambda s: (KINDS.index(s[2]), s[0]))))
    return out


def span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for start, stop, kind in spans)


_NEEDED = np.zeros(256, dtype=bool)
_NEEDED[[*range(48, 58), 64]] = True


def _scan(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts, n = batch.column("text"), batch.num_rows
            suspect = np.zeros(n, dtype=bool)
            for slab in slabs(texts):
                where = np.flatnonzero(_NEEDED[slab.data])
                suspect[slab.first + np.searchsorted(slab.offsets, where, side="right") - 1] = True
            counts = np.zeros((len(KINDS), n), dtype=np.int64)
            digest, spans = [nothing] * n, [""] * n
            chosen = np.flatnonzero(suspect)
            for lo in range(0, len(chosen), 16):
                rows = chosen[lo : lo + 16]
                for i, (base, found) in zip(rows, find_personal([texts[int(i)].as_py() or "" for i in rows], model), strict=True):
                    for *_, kind in base:
                        counts[KINDS.index(kind), i] += 1
                    digest[i] = hashlib.sha256(span_text(base).encode()).hexdigest()
                    spans[i] = span_text(found)
            yield pa.record_batch([batch.column("id"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def scan_personal(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return ``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, a row for each row of ``docs``.

    Counts and ``base_sha256`` are of the fixed patterns; ``spans`` lists those and
    the model's as ``kind:start:stop`` in code points, by kind, then start. A null
    text counts as empty and has no spans. Rows that repeat an id are scanned one
    by one; a null id stays null. Other columns are ignored. An empty table gives
    an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = train_tagger()
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_scan(model), f"id {kind}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_column)
