"""Language by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its lower-cased byte trigrams and tetragrams, white space taken as one byte. Their hashed
embeddings are averaged and a linear layer gives the logits; both are trained in numpy by stochastic gradient
descent on a bounded sample of whole texts. As the average is linear, scoring looks up the product of the two tables. Confidence
is calibrated by a temperature on documents kept from training; the rejection limit comes from the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, share, utf8

BUCKETS, DIM = 1 << 15, 16
PIECE = 1 << 20
#: A letter: a sign of category L, in training and scoring alike. Numbers written as letters or signs are none.
IS_LETTER = r"\p{L}"
LETTER = regex.compile(IS_LETTER)
FOLD = np.array([32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
LEAST_OF_EACH = 20


def buckets(text: bytes) -> Iterator[np.ndarray]:
    """Bucket of every trigram and tetragram of a text with spaces added at both ends, PIECE places at a time."""
    text = b" " + text + b"   "
    for lo in range(0, len(text) - 3, PIECE):
        yield mixed(FOLD[np.frombuffer(text[lo : lo + PIECE + 3], np.uint8)].astype(np.uint32))


def mixed(data: np.ndarray) -> np.ndarray:
    three = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    four = three[:-1] | data[3:] << np.uint32(24)
    both = np.concatenate([three[:-1] * np.uint32(2654435761), (four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)])
    return (both >> np.uint32(17)).astype(np.int32)


@dataclass
class Model:
    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    limit: float = 0.0

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.names)), 0
        for found in buckets(text):
            total += self.table[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / n + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        """('und', 0) without letters or without a learned language."""
        if not self.names or not LETTER.search(text.decode(errors="replace")):
            return "und", 0.0
        z = self.logits(text) * self.heat
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.names[best], float(p[best] / p.sum())


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, read in pieces, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for found in buckets(text):
        total += np.bincount(found, minlength=BUCKETS)
    met = np.flatnonzero(total)
    return met.astype(np.int32), total[met].astype(np.int32)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def step(x: np.ndarray, index: np.ndarray, y: int, embed: np.ndarray, linear: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one text's log loss: of its embeddings (rows `index`), the linear layer and the bias."""
    mean = x @ embed[index]
    p = softmax(mean @ linear + bias)
    p[y] -= 1
    return np.outer(x, linear @ p), np.outer(mean, p), p


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 3, rate: float = 0.5, seed: int = 5) -> Model:
    """Fits on counted texts: four fifths train, the rest calibrate the temperature and the rejection limit."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    linear, bias = rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    number = {name: k for k, name in enumerate(names)}
    y = np.array([number[x] for x in langs])
    part = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    for epoch in range(epochs):
        size = rate * (1 - epoch / epochs)
        for r in rng.permutation(np.flatnonzero(~part)):
            index, counts = rows[r]
            of_embed, of_linear, of_bias = step(counts / counts.sum(), index, y[r], embed, linear, bias)
            embed[index] -= 20 * size * of_embed
            linear -= size * of_linear
            bias -= 0.1 * size * of_bias
    m = Model(names, (embed @ linear).astype(np.float32), bias)
    held = np.flatnonzero(part) if part.any() else np.arange(len(rows))
    z = np.array([(rows[r][1] / rows[r][1].sum()) @ m.table[rows[r][0]] + bias for r in held])

    def loss(heat: float) -> float:
        return float(-np.log(softmax(z * heat)[np.arange(len(held)), y[held]] + 1e-300).mean())

    m.heat = min(np.geomspace(0.25, 16, 49), key=loss)
    sure = softmax(z * m.heat).max(1)
    right = z.argmax(1) == y[held]
    # the limit rejects at most one in 500 of the documents that are told apart rightly, and nothing told by a majority
    m.limit = float(min(0.5, np.quantile(sure[right], 0.002))) if right.any() else 0.0
    return m


def train(docs: DataFrame, fold: int = 3, held: int = 1, bound: int = 4_000) -> Model:
    """Fits on about `bound` whole texts outside the held-out fold, as many of each language; at least about
    LEAST_OF_EACH of each, or all where there are fewer, so that a rare language is learned on a table of any size.

    Texts without letters are left out. Distinct buckets and counts come to the driver, at most 2 ** 15 a text; texts do not.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (remainder("doc_id", fold) != held) & F.col("text").rlike(IS_LETTER))
    sizes = known.groupBy("lang").count()
    quota = max(LEAST_OF_EACH, bound // max(1, sizes.count()))
    drawn = known.join(F.broadcast(sizes), "lang").where(share(["doc_id", "text"], 23) < F.lit(quota) / F.col("count")).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t) for t in utf8(batch.column(1))]
            at = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, kind), *(row[k].astype(kind) for row in found)]))) for k, kind in enumerate((np.int16, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["doc_id", "lang", "i", "n"])

    found = drawn.mapInArrow(run, "doc_id long, lang string, i array<smallint>, n array<int>").toArrow()
    order = sorted(range(found.num_rows), key=lambda k: (found["doc_id"][k].as_py() is None, found["doc_id"][k].as_py() or 0, found["lang"][k].as_py()))
    lists = [found.column(name) for name in "in"]  # seen in place, not copied
    return fit([tuple(x[k].values.to_numpy() for x in lists) for k in order], [found["lang"][k].as_py() for k in order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), a row for each row. rejected: below the calibrated limit, or `und`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** 15 numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "lang_pred": pa.array([x for x, _ in found], pa.string()),
                    "score": pa.array([s for _, s in found], pa.float64()),
                    "rejected": pa.array([x == "und" or s < sent.value.limit for x, s in found], pa.bool_()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document, a row for each row.

    Null, empty and letterless texts are `und` with score 0, and so is every text where no row has a lang. Repeated rows
    get equal rows, an empty table none.
    """
    found = predict(docs, train(docs, fold, held))
    return found.select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows that are not rejected; columns and repeated rows as they are, no shuffle.

    Null, empty and letterless texts go. Where no row has a lang nothing is told apart and every row goes; an empty
    table gives an empty one. Null ids are judged like others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t) for t in utf8(batch.column("text"))]
            yield batch.filter(pa.array([x != "und" and s >= sent.value.limit for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
