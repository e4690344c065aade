"""Toxicity by a convolutional text classifier.

Hashed embeddings of lower-cased words (the sum of the whole word's and of those of its first four and six bytes),
filters over one, two and three words, the maximum of each filter over the whole text, a linear layer. All of it
starts at random and is trained in numpy on a bounded sample, by AdaGrad on mini-batches in which both classes weigh
the same; only the words at a filter's maximum get a gradient. Buckets that fewer than LEAST_DOCS training documents
have keep no embedding, so that rare words can't tell a document apart. The epoch with the least loss on a quarter kept from training
counts. That quarter also gives the cuts, calibrated by predicted language and moved onto one cut of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import distinct, labelled_sample, remainder, utf8
from .quality import best_cut, sigmoid

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 12, (1, 2, 3), 8
PARTS, LEAST_DOCS = (None, 4, 6), 3
OUT = FILTERS * len(WIDTHS)
EDGE = b".,;:!?\"'()[]{}<>#$%&*+-=_/\\|~^`@"
PIECE = 1 << 16


def word_ids(text: bytes) -> np.ndarray:
    """Buckets of every word and of its beginnings, a row each: one empty place before the text, two after it (-1)."""
    words = [w.strip(EDGE) for w in text.lower().split()]
    out = np.full((len(PARTS), len(words) + 3), -1, np.int32)
    if words:
        for k, n in enumerate(PARTS):
            out[k, 1:-2] = [crc32(w[:n], k) % BUCKETS for w in words]
    return out


@dataclass
class Net:
    """row holds the place of each bucket's embedding, 0 where it has none: embed[0] stays zero."""

    row: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]
    offset: np.ndarray
    out: np.ndarray
    bias: float
    cuts: dict[str, float]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, 0, self.row[ids])

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter and where it starts, block by block."""
        top, at = np.full(OUT, -np.inf), np.zeros(OUT, np.int64)
        starts, wide = rows.shape[1] - 2, np.concatenate([f for filters in self.filters for f in filters], axis=1)
        for lo in range(0, starts, PIECE):
            x = self.embed[rows[:, lo : lo + PIECE + 2]].sum(0)
            y, n, k = x @ wide, min(PIECE, starts - lo), 0
            z = np.empty((n, OUT), np.float32)
            for w, width in enumerate(WIDTHS):
                z[:, w * FILTERS : (w + 1) * FILTERS] = sum(y[i : i + n, (k + i) * FILTERS : (k + i + 1) * FILTERS] for i in range(width))
                k += width
            best = z.argmax(0)
            value = z[best, np.arange(OUT)]
            at = np.where(value > top, best + lo, at)
            top = np.maximum(top, value)
        return top + self.offset, at

    def logit(self, text: bytes) -> float:
        return float(np.maximum(self.pooled(self.rows(word_ids(text)))[0], 0) @ self.out + self.bias)

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weigh: np.ndarray) -> tuple:
        """Of the mean weighted log loss of texts (embedding rows of their words): those of the embeddings met, of the
        filters, the offsets, the output layer and its bias.
        """
        found = [self.pooled(t) for t in texts]
        z = np.array([v for v, _ in found])
        act = np.maximum(z, 0)
        g = weigh * (sigmoid(act @ self.out + self.bias) - y) / len(texts)
        back = g[:, None] * self.out * (z > 0)
        of_filters, met, change = [np.zeros_like(f) for f in self.filters], [], []
        for w, width in enumerate(WIDTHS):
            span = slice(w * FILTERS, (w + 1) * FILTERS)
            for k in range(width):
                words = np.array([t[:, at[span] + k] for t, (_, at) in zip(texts, found)])  # text, part, filter
                x = self.embed[words].sum(1)
                of_filters[w][k] = np.einsum("bf,bfd->df", back[:, span], x)
                own = back[:, span, None] * self.filters[w][k].T
                met.append(words.transpose(1, 0, 2).ravel())
                change.append(np.tile(own.reshape(-1, DIM), (len(PARTS), 1)))
        met, change = np.concatenate(met), np.concatenate(change)
        order = np.argsort(met, kind="stable")
        rows, first = np.unique(met[order], return_index=True)
        change = np.add.reduceat(change[order], first)
        change[rows == 0] = 0
        return (rows, change), of_filters, back.sum(0), g @ act, float(g.sum())


def untrained(rows: list[np.ndarray], seed: int = 9) -> Net:
    """A net at random, with an embedding for every bucket that LEAST_DOCS of the texts (rows of word_ids) have."""
    rng = np.random.default_rng(seed)
    held = np.zeros(BUCKETS, np.int32)
    for ids in rows:
        held[distinct(ids[ids >= 0])] += 1
    kept = np.flatnonzero(held >= LEAST_DOCS)
    row = np.zeros(BUCKETS, np.int32)
    row[kept] = np.arange(1, len(kept) + 1)
    embed = rng.normal(0, 0.1, (len(kept) + 1, DIM)).astype(np.float32)
    embed[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Net(row, embed, filters, np.zeros(OUT), rng.uniform(0.1, 0.5, OUT), -1.0, {"": 0.0})


def fit(texts: list[bytes], y: np.ndarray, langs: list[str], epochs: int = 14, rate: float = 0.03, batch: int = 32, seed: int = 9) -> Net:
    ids = [word_ids(t) for t in texts]
    part = np.arange(len(ids)) % 4 == 0 if len(ids) >= 80 else np.zeros(len(ids), bool)
    use = np.flatnonzero(~part)
    net, rng = untrained([ids[r] for r in use], seed), np.random.default_rng(seed)
    if not len(use) or not 0 < y[use].sum() < len(use):
        return net
    rows = [net.rows(x) for x in ids]
    held = np.flatnonzero(part) if part.any() else use
    share = y[use].mean()
    weigh = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))

    def logits(some: np.ndarray) -> np.ndarray:
        return np.array([np.maximum(net.pooled(rows[r])[0], 0) @ net.out + net.bias for r in some])

    def loss() -> float:
        z = logits(held)
        return float((weigh[held] * np.logaddexp(0, np.where(y[held] == 1, -z, z))).mean())

    slow = [np.full_like(x, 1e-6) for x in (net.embed, *net.filters, net.offset, net.out)]
    best, least, slow_bias = deepcopy(net), np.inf, 1e-6
    for _ in range(epochs):
        order = rng.permutation(use)
        for some in np.array_split(order, -(-len(order) // batch)):
            (met, of_embed), of_filters, of_offset, of_out, of_bias = net.gradients([rows[r] for r in some], y[some], weigh[some])
            slow[0][met] += of_embed**2
            net.embed[met] -= rate * of_embed / np.sqrt(slow[0][met])
            for x, gradient, seen in zip([*net.filters, net.offset, net.out], [*of_filters, of_offset, of_out], slow[1:]):
                gradient = gradient + 1e-4 * x
                seen += gradient**2
                x -= 0.5 * rate * gradient / np.sqrt(seen)
            slow_bias += of_bias**2
            net.bias -= 0.5 * rate * of_bias / np.sqrt(slow_bias)
        now = loss()
        if now < least:
            best, least = deepcopy(net), now
    net = best
    z = logits(held)
    if 0 < y[held].sum() < len(held):
        net.cuts[""] = best_cut(z, y[held])
        for lang in set(langs):
            own = np.array([langs[r] == lang for r in held])
            if y[held][own].sum() >= 20:
                net.cuts[lang] = best_cut(z[own], y[held][own])
    return net


def train(docs: DataFrame, labels: DataFrame, guess: langid.Model, fold: int = 3, held: int = 1, bound: int = 8_000) -> Net:
    """Fits on about `bound` labelled documents outside the held-out fold, whole texts."""
    rows = labelled_sample(docs, labels, "toxic", fold, held, bound).select("doc_id", "text", "y").toArrow().sort_by("doc_id")
    texts = utf8(rows.column("text").combine_chunks()) if rows.num_rows else []
    return fit(texts, np.array(rows.column("y").to_pylist(), float), [guess.predict(t)[0] for t in texts])


def score(docs: DataFrame, net: Net, guess: langid.Model, cut: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted), a row for each row: `cut` is where the predicted language's own cut lies."""
    sent = docs.sparkSession.sparkContext.broadcast((net, guess))  # tables of a fixed size and an embedding a frequent bucket of the bounded sample: about 7 MB
    level = float(np.log(cut / (1 - cut)))

    def one(text: bytes) -> float:
        net, guess = sent.value
        lang = guess.predict(text)[0] if len(net.cuts) > 1 else ""
        return 1 / (1 + np.exp(-np.clip(net.logit(text) - net.cuts.get(lang, net.cuts[""]) + level, -30, 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([one(t) for t in utf8(batch.column(1))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, a row for each row.

    Null texts count as empty; repeated rows get equal rows, an empty table none. Without labels, or with those of one
    class only, nothing is trained: scores then say nothing.
    """
    guess = langid.train(docs, fold, held)
    found = score(docs, train(docs, labels, guess, fold=fold, held=held), guess)
    return found.select("doc_id", (remainder("doc_id", fold) == held).alias("held_out"), "score", "predicted")
