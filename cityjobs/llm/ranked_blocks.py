"""Ranked lexical search over posting lists in geometric blocks.

Documents are indexed in shards. Inside a shard each term's posting list is clustered by the similarity of its documents:
some of them are centroids, and every posting joins the one its document is most like, by a random projection of the
documents' impacts. Such a block stores the coordinatewise maximum of its documents' impacts. A query reads the
blocks of its essential terms (a document without any of them can't reach the 20th score) and skips a block only when
the product of the query and the block's summary, which no document of the block exceeds, is below the 20th score so far.
The documents of the other blocks are scored exactly, in integers.

The index is built for a block of queries at a time: of their terms, lists of those that are essential to some query, and summaries over the
terms that those queries have. Scores start from the 20th of each query in a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, utf8

#: In UTF-8: signs beyond ASCII, digits and letters; A-Z are folded before.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Queries and their distinct terms in one block; cells of a shard's matrix and its documents; postings of a block; sampled documents.
QUERIES_AT_ONCE, TERMS_AT_ONCE, SHARD_CELLS, SHARD_DOCS, BLOCK, SAMPLE = 1_000, 8_192, 1 << 24, 4_096, 32, 20_000
SKETCH = 16
#: Shards of a file, which a task takes in at once; queries and documents that are looked at with one matrix of doubles.
SHARDS_A_FILE, COLUMNS_AT_ONCE, ROWS_AT_ONCE = 2, 128, 1_024
SHARD = "doc_ids array<long>, at array<int>, terms array<int>, impacts array<int>, list_term array<int>, list_at array<int>, block_at array<int>, postings array<int>, coord_at array<int>, coords array<int>, maxima_at array<int>, maxima array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """bytes.lower folds A-Z alone."""
    return TERM.findall(text.lower())


@dataclass
class Queries:
    """A block of queries: the ids of the items that ask each, the numbers of their terms, and how often each has each
    (terms x queries). Items of the same terms are one query.
    """

    ids: list[list[int | None]]
    vocabulary: dict[bytes, int]
    counts: np.ndarray

    @classmethod
    def of(cls, asked: dict[tuple[bytes, ...], list[int | None]]) -> Queries:
        names = {t: k for k, t in enumerate(sorted({t for terms in asked for t in terms}))}
        counts = np.zeros((len(names), len(asked)))
        for k, terms in enumerate(asked):
            for t, n in Counter(terms).items():
                counts[names[t], k] = n
        return cls(list(asked.values()), names, counts)


def blocks_of(items: DataFrame) -> Iterator[Queries]:
    """The items with terms, QUERIES_AT_ONCE or TERMS_AT_ONCE a block, one at least."""
    asked: dict[tuple[bytes, ...], list[int | None]] = {}
    seen: set[bytes] = set()
    for r in items.select("item_id", "text").toLocalIterator():
        terms = tuple(sorted(terms_of((r["text"] or "").encode())))
        if not terms:
            continue
        if asked and terms not in asked and (len(asked) >= QUERIES_AT_ONCE or len(seen | set(terms)) > TERMS_AT_ONCE):
            yield Queries.of(asked)
            asked, seen = {}, set()
        asked.setdefault(terms, []).append(r["item_id"])
        seen |= set(terms)
    if asked:
        yield Queries.of(asked)


def lists(*columns: tuple[np.ndarray, np.ndarray]) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values)) for at, values in columns]


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tf) of the documents with terms: how many in all, and which of the queries' how often."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)  # of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            sizes, found = [], []
            for text in utf8(batch.column(1)):
                words = terms_of(text)
                sizes.append(len(words))
                met = Counter(map(number, words))
                met.pop(None, None)
                found.append(met)
            n = np.array(sizes, np.int64)
            at = np.cumsum([0, *map(len, found)])
            terms = np.fromiter((t for met in found for t in met), np.int32, at[-1])
            tf = np.fromiter((c for met in found for c in met.values()), np.int32, at[-1])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists((at, terms), (at, tf))], names=["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What one unit of a term's weight counts in a document of `size` terms."""
    m = 75 + 25 * size * n // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Shard:
    """Some documents' impacts as a matrix, exact in single precision as they are below a million."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int) -> None:
        self.dense = np.zeros((len(at) - 1, n_terms), np.float32)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.dense[self.row, terms] = values
        self.top = self.dense.max(0, initial=0).astype(np.float64)

    def essential(self, weighed: np.ndarray, least: np.ndarray) -> np.ndarray:
        """terms x queries: the terms without which a document stays below the query's least score.

        Of each query those of the least possible shares are left out as long as they do not reach it together.
        """
        out = np.zeros(weighed.shape, bool)
        for lo in range(0, len(least), COLUMNS_AT_ONCE):
            share = weighed[:, lo : lo + COLUMNS_AT_ONCE] * self.top[:, None]
            order = np.argsort(share, axis=0)
            left_out = np.zeros(share.shape, bool)
            np.put_along_axis(left_out, order, np.cumsum(np.take_along_axis(share, order, 0), 0) < least[lo : lo + COLUMNS_AT_ONCE], 0)
            out[:, lo : lo + COLUMNS_AT_ONCE] = (share > 0) & ~left_out
        return out

    def scores(self, docs: np.ndarray, terms: np.ndarray, weighed: np.ndarray) -> np.ndarray:
        """Exact: sums of whole numbers that doubles hold."""
        return self.dense[np.ix_(docs, terms)].astype(np.float64) @ weighed[terms]


def clustered(sketch: np.ndarray) -> np.ndarray:
    """The block of each posting: the centroid, of every BLOCK-th document, that its document is most like."""
    centroids = sketch[::BLOCK]
    return (sketch @ centroids.T).argmax(1) if len(centroids) > 1 else np.zeros(len(sketch), np.int64)


def index_of(at: np.ndarray, terms: np.ndarray, values: np.ndarray, weighed: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """The lists of one shard, their blocks and summaries, flat.

    list_at: blocks of each list; block_at: postings of each block; coord_at: terms that a list's summaries are over;
    maxima_at: a list's summaries, a row of maxima a block.
    """
    shard = Shard(at, terms, values, len(weighed))
    needs, has = shard.essential(weighed, least), weighed > 0
    sketch = shard.dense @ np.random.default_rng(7).normal(size=(len(weighed), SKETCH)).astype(np.float32)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    by_term = np.argsort(terms, kind="stable")
    ends = np.searchsorted(terms[by_term], np.arange(len(weighed) + 1))
    out: dict[str, list] = {k: [] for k in ("list_term", "postings", "coords", "maxima")}
    sizes: dict[str, list[int]] = {k: [0] for k in ("list_at", "block_at", "coord_at", "maxima_at")}
    for t in np.flatnonzero(needs.any(1)):
        docs = shard.row[by_term[ends[t] : ends[t + 1]]]
        own = clustered(sketch[docs])
        order = np.argsort(own, kind="stable")
        docs, start = docs[order], np.flatnonzero(np.diff(own[order], prepend=-1))
        coords = np.flatnonzero(has[:, needs[t]].any(1))
        maxima = np.maximum.reduceat(shard.dense[np.ix_(docs, coords)], start, axis=0)
        out["list_term"].append([t])
        out["postings"].append(docs)
        out["coords"].append(coords)
        out["maxima"].append(maxima.ravel())
        sizes["list_at"].append(len(start))
        sizes["block_at"] += np.diff(start, append=len(docs)).tolist()
        sizes["coord_at"].append(len(coords))
        sizes["maxima_at"].append(maxima.size)
    return {k: np.concatenate([np.zeros(0), *v]).astype(np.int32) for k, v in out.items()} | {k: np.cumsum(v) for k, v in sizes.items()}


class Best:
    """Each query's first `most` documents so far and the least score that still counts."""

    def __init__(self, least: np.ndarray, most: int) -> None:
        self.least, self.most = least.copy(), most
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in least]

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least[q]
        if not keep.any():
            return
        s, i = (np.concatenate(x) for x in zip(self.rows[q], (scores[keep], ids[keep])))
        order = np.lexsort((i, -s))[: self.most]
        self.rows[q] = s[order], i[order]
        if len(order) == self.most:
            self.least[q] = max(self.least[q], s[order[-1]])


def searched(shard: Shard, index: dict[str, np.ndarray], weighed: np.ndarray, ids: np.ndarray, best: Best) -> tuple[int, int]:
    """Reads one shard's index; how many blocks were bounded and how many of them read."""
    needs, wanted = shard.essential(weighed, best.least), np.zeros((weighed.shape[1], len(ids)), bool)
    bounded = read = 0
    for k, t in enumerate(index["list_term"]):
        queries = np.flatnonzero(needs[t])
        if not len(queries):
            continue
        first, last = index["list_at"][k : k + 2]
        coords = index["coords"][index["coord_at"][k] : index["coord_at"][k + 1]]
        maxima = index["maxima"][index["maxima_at"][k] : index["maxima_at"][k + 1]].reshape(last - first, len(coords)).astype(np.float64)
        for some in (queries[lo : lo + COLUMNS_AT_ONCE] for lo in range(0, len(queries), COLUMNS_AT_ONCE)):
            block, q = np.nonzero(maxima @ weighed[np.ix_(coords, some)] >= best.least[some])
            bounded, read = bounded + (last - first) * len(some), read + len(block)
            starts, ends = index["block_at"][first:last][block], index["block_at"][first + 1 : last + 1][block]
            for a, b, query in zip(starts, ends, some[q]):
                wanted[query, index["postings"][a:b]] = True
    for query in np.flatnonzero(wanted.any(1)):
        docs = np.flatnonzero(wanted[query])
        best.take(query, shard.scores(docs, np.flatnonzero(weighed[:, query]), weighed[:, query]), ids[docs])
    return bounded, read


LAST = np.iinfo(np.int64).max


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of lists, both from 0."""
    at = column.offsets.to_numpy()
    return at - at[0], column.flatten().to_numpy(zero_copy_only=False)


def ranked_block(spark: SparkSession, docs: DataFrame, queries: Queries, most: int) -> DataFrame:
    path = scratch(spark, "vectors")
    vectors(docs, queries).write.parquet(path)
    rows = spark.read.parquet(path)
    stats = rows.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    n, total, n_terms = stats["n"], stats["total"] or 1, len(queries.vocabulary)
    df = np.zeros(n_terms)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the queries
        df[r["t"]] = r["count"]
    weighed = weights(n, df)[:, None] * queries.counts
    sent = spark.sparkContext.broadcast(weighed)
    docs_at_once = max(16, min(SHARD_DOCS, SHARD_CELLS // n_terms))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(doc_ids, offsets, terms, impacts) of docs_at_once documents at a time."""
        held: list[pa.RecordBatch] = []
        size = 0

        def cut() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at, terms = flat(batch.column("terms"))
            tf = flat(batch.column("tf"))[1].astype(np.int64)
            return batch.column("doc_id"), at, terms, impacts(tf, np.repeat(batch.column("n").to_numpy(), np.diff(at)), n, total)

        for whole in batches:
            for lo in range(0, len(whole), docs_at_once):
                batch = whole.slice(lo, docs_at_once)
                if held and size + len(batch) > docs_at_once:
                    yield cut()
                    held, size = [], 0
                held.append(batch)
                size += len(batch)
        if size:
            yield cut()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, sent.value.shape[1]))
        for _, at, terms, values in shards(batches):
            dense = Shard(at, terms, values, n_terms).dense
            for part in (dense[lo : lo + ROWS_AT_ONCE].astype(np.float64) for lo in range(0, len(dense), ROWS_AT_ONCE)):
                best = -np.sort(-np.concatenate([best, part @ sent.value]), axis=0)[:most]
        place, query = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best[place, query].astype(np.int64))], names=["q", "score"])

    least = np.ones(len(queries.ids))  # only scores above 0 count
    some = rows.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n))))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    for r in some.mapInArrow(sampled, "q int, score long").withColumn("_n", place).where(F.col("_n") == most).collect():
        least[r["q"]] = r["score"]
    bound = spark.sparkContext.broadcast(least)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SHARD.split(", ")]
        for doc_ids, at, terms, values in shards(batches):
            row = {"at": at, "terms": terms, "impacts": values} | index_of(at, terms, values, sent.value, bound.value)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (doc_ids, *(pa.array(row[c].astype(np.int32)) for c in names[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(bound.value, most)
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "doc_ids"}
                ids = batch.column("doc_ids")[k].values.fill_null(LAST).to_numpy()
                searched(Shard(row["at"], row["terms"], row["impacts"], n_terms), row, sent.value, ids, best)
        found = [(np.full(len(s), q, np.int32), i, s.astype(np.int64)) for q, (s, i) in enumerate(best.rows)]
        columns = [pa.array(np.concatenate(x)) for x in zip(*found)]
        yield pa.RecordBatch.from_arrays(columns, names=["q", "doc_id", "score"])

    path = scratch(spark, "posting_blocks")
    # a task reads a file's rows as one: files of a few shards bound it, however many shards a task builds
    rows.select("doc_id", "n", "terms", "tf").mapInArrow(build, SHARD).write.option("maxRecordsPerFile", SHARDS_A_FILE).parquet(path)
    found = spark.read.parquet(path).mapInArrow(search, "q int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame([(q, i) for q, ids in enumerate(queries.ids) for i in ids], "_q int, item_id long")  # one block of queries
    found = found.withColumn("rank", rank).where(F.col("rank") <= most).join(F.broadcast(names), F.col("q") == F.col("_q"))
    return found.select("item_id", "rank", F.nullif("doc_id", F.lit(int(LAST))).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `most` highest-scoring documents with a score above 0.

    Null and empty texts have no terms and are found by nothing; an item without terms finds nothing. Every row of docs
    ranks for itself, rows that repeat a doc_id too; of equal scores the smaller doc_id comes first, null last. Each row of items is
    a query of its own, whether its id is null or repeated. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = None
    for queries in blocks_of(items):
        some = ranked_block(spark, docs, queries, most)
        found = some if found is None else found.unionByName(some)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
