"""Quality scores by a factorisation machine.

Features: hashed words (value: share of the text's words), hashed word shapes (what stands around a word's letters,
and its case), hashed metadata columns (numbers by their power of two) and structure statistics of the text. A score
is w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2], linear in the number of features. The model is
fitted in numpy by AdaGrad on mini-batches of a bounded sample of labelled documents, whose features are held as
flat arrays; the tables have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, utf8

WORDS, SHAPES, META, FACTORS = 1 << 14, 1 << 10, 1 << 8, 8
LETTER = bytes(1 if chr(b).isalpha() or b >= 128 else 0 for b in range(256))
#: Byte classes: lower case, upper case, digit, white space, sentence mark, other sign, beyond ASCII.
CLASS = np.array([3 if b in b" \t\n\v\f\r" else 2 if 48 <= b < 58 else 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 6 if b >= 128 else 4 if b in b".,;:?'\"()-" else 5 for b in range(256)], np.uint8)
STATS = 16
SIZE = WORDS + SHAPES + META + STATS
META_VALUE = 0.25
STRIP = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def features(text: bytes, meta: Sequence[tuple[str, object]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of a text and its metadata (name, value); statistics come last and are not
    yet scaled.
    """
    words = text.split()
    n = len(words)
    index, value = np.zeros(0, np.int64), np.zeros(0)
    tails, upper = 0, 0
    if n:
        bare = [w.strip(STRIP) for w in words]
        keys = [crc32(b.lower()) % WORDS for b in bare]
        shapes = [WORDS + crc32(w[-3:].strip(b"abcdefghijklmnopqrstuvwxyz") + (b"A" if b.isupper() and len(b) > 1 else b"a")) % SHAPES if len(w) != len(b) or b.isupper() else WORDS for w, b in zip(words, bare)]
        tails = sum(len(w) - len(b) > 1 for w, b in zip(words, bare))
        upper = sum(b.isupper() and len(b) > 1 for b in bare)
        index, counts = np.unique(np.array(keys + shapes), return_counts=True)
        value = counts / n
    size = max(1, len(text))
    kinds = np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=7) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    stats = [
        *kinds,
        np.log1p(n),
        np.log1p(len(text)),
        (size - kinds[3] * size) / max(1, n),
        tails / max(1, n),
        upper / max(1, n),
        len(set(words)) / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        ended / max(1, len(lines)),
        np.log1p(len(lines)),
    ]
    told = [WORDS + SHAPES + crc32(f"{name}={level(x)}".encode()) % META for name, x in meta]
    return np.concatenate([index, told, np.arange(SIZE - STATS, SIZE)]).astype(np.int32), np.concatenate([value, np.full(len(told), META_VALUE), stats]).astype(np.float32)


def level(x: object) -> object:
    """A number's power of two, with its sign; other values as they are."""
    if isinstance(x, bool) or not isinstance(x, int | float) or x != x:
        return x
    power = int(np.log2(min(abs(x), 1e300) + 1))
    return -power if x < 0 else power


@dataclass
class Rows:
    """Features of many texts: those of row r are index[at[r] : at[r + 1]] and value[...]."""

    at: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        at = np.cumsum([0, *(len(i) for i, _ in found)])
        return cls(at, np.concatenate([np.zeros(0, np.int32), *(i for i, _ in found)]), np.concatenate([np.zeros(0, np.float32), *(x for _, x in found)]))

    def __len__(self) -> int:
        return len(self.at) - 1

    def stats(self) -> np.ndarray:
        return self.value[self.at[1:, None] - STATS + np.arange(STATS)]

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.at[rows + 1] - self.at[rows]
        at = np.append(0, np.cumsum(sizes))
        place = np.repeat(self.at[rows] - at[:-1], sizes) + np.arange(at[-1])
        return Rows(at, self.index[place], self.value[place])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shift: float = 0.0

    def scaled(self, rows: Rows) -> Rows:
        value = rows.value.copy()
        value[rows.at[1:, None] - STATS + np.arange(STATS)] = np.clip((rows.stats() - self.mean) / self.scale, -4, 4) / 4
        return Rows(rows.at, rows.index, value)

    def forward(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of scaled rows, each feature's factors times its value, and their sums a row."""
        each = self.factor[rows.index] * rows.value[:, None]
        total, squares = (np.add.reduceat(x, rows.at[:-1]) for x in (each, each**2))
        return self.bias + np.add.reduceat(self.weight[rows.index] * rows.value, rows.at[:-1]) + 0.5 * (total**2 - squares).sum(1), each, total

    def logits(self, rows: Rows) -> np.ndarray:
        return self.forward(self.scaled(rows))[0] if len(rows) else np.zeros(0)

    def scores(self, rows: Rows) -> np.ndarray:
        return sigmoid(self.logits(rows) + self.shift)

    def gradients(self, rows: Rows, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of the weighted log loss of scaled rows: the indices met, then their weights', factors' and the bias' gradient."""
        z, each, total = self.forward(rows)
        g = weigh * (sigmoid(z) - y)
        row = np.repeat(np.arange(len(rows)), np.diff(rows.at))
        gx = g[row] * rows.value
        order = np.argsort(rows.index, kind="stable")
        met, first = np.unique(rows.index[order], return_index=True)
        return met, np.add.reduceat(gx[order], first), np.add.reduceat((gx[:, None] * (total[row] - each))[order], first), float(g.sum())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: Rows, y: np.ndarray, cut: float, epochs: int = 12, rate: float = 0.15, batch: int = 16, seed: int = 3, factors: int = FACTORS) -> Machine:
    """Fits on four fifths; the rest sets the shift that puts the best cut between the classes at `cut`."""
    rng = np.random.default_rng(seed)
    stats = rows.stats() if len(rows) else np.zeros((1, STATS))
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, factors)), stats.mean(0), stats.std(0) + 1e-6)
    if len(np.unique(y)) < 2:  # no evidence: just at the cut, or below it if all labels are 0
        m.factor[:], m.shift = 0.0, float(np.log(cut / (1 - cut))) + (1e-9 if not len(y) or y[0] else -1.0)
        return m
    part = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    share = min(0.99, max(0.01, float(y.mean())))
    weigh = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    scaled = m.scaled(rows)
    sum_w, sum_v, sum_b = np.full(SIZE, 1e-2), np.full((SIZE, factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~part))
        for some in np.array_split(order, -(-len(order) // batch)):
            met, gw, gv, gb = m.gradients(scaled.take(some), y[some], weigh[some])
            gw += 1e-5 * m.weight[met]
            gv += 1e-5 * m.factor[met]
            sum_w[met] += gw**2
            sum_v[met] += gv**2
            sum_b += gb * gb
            m.weight[met] -= rate * gw / np.sqrt(sum_w[met])
            m.factor[met] -= 0.3 * rate * gv / np.sqrt(sum_v[met])
            m.bias -= rate * gb / np.sqrt(sum_b)
    held = np.flatnonzero(part) if part.any() else np.arange(len(rows))
    m.shift = float(np.log(cut / (1 - cut))) - best_cut(m.logits(rows.take(held)), y[held])
    return m


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the classes with the fewest errors; the middle of the best stretch of logits."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.append(0, np.cumsum(y == 1)) + np.append(np.cumsum((y == 0)[::-1])[::-1], 0)
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def read(batch: pa.RecordBatch, metadata: Sequence[str]) -> Rows:
    told = [batch.column(name).to_pylist() for name in metadata]
    return Rows.of([features(t, list(zip(metadata, row))) for t, *row in zip(utf8(batch.column("text")), *told)])


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.3, fold: int = 5, held: int = 0, bound: int = 8_000, metadata: Sequence[str] = ()) -> Machine:
    """Features of about `bound` labelled documents come to the driver, as flat arrays; texts do not.

    Without labelled rows, or with those of one class only, nothing is fitted: all texts score alike, see `scored`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = read(batch, metadata)
            lists = [pa.ListArray.from_arrays(pa.array(rows.at, pa.int32()), pa.array(x)) for x in (rows.index, rows.value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists], names=["doc_id", "y", "i", "x"])

    sample = labelled_sample(docs, labels, "quality", fold, held, bound, metadata)
    found = sample.mapInArrow(run, "doc_id long, y int, i array<int>, x array<float>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    lists = [found.column(name).combine_chunks() for name in "ix"]
    index, value = (x.values.to_numpy() if found.num_rows else np.zeros(0, kind) for x, kind in zip(lists, (np.int32, np.float32)))
    at = lists[0].offsets.to_numpy() if found.num_rows else np.zeros(1, np.int64)
    return fit(Rows(at, index, value).take(order), found.column("y").to_numpy()[order].astype(float), cut)


def score(docs: DataFrame, machine: Machine, cut: float = 0.3, metadata: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score, predicted), a row for each row. Null and empty texts are scored by their statistics."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # about 1.3 MB, whatever the corpus holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.scores(read(batch, metadata))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text", *metadata).mapInArrow(run, "doc_id long, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, metadata: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, a row for each row.

    Null and empty texts are scored by their statistics. Without labels, or with those of
    class 1 only, every document scores the cut and is predicted 1; with those of class 0 only all are predicted 0. Repeated rows get equal rows, an empty table none.
    """
    return score(docs, train(docs, labels, fold=fold, held=held, metadata=metadata), metadata=metadata).select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, metadata: Sequence[str] = ()) -> DataFrame:
    """The rows that score `cut` or more themselves; columns and repeated rows as they are, no shuffle.

    Null and empty texts are judged by their statistics, null ids like others. Without labels, or with those
    of class 1 only, all rows stay, with those of class 0 only none; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, cut, metadata=metadata))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(read(batch, metadata)) >= cut))

    return docs.mapInArrow(run, docs.schema)
