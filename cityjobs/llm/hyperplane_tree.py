"""Hard negatives by a multiway hyperplane tree.

A node has several split points; a row goes to the child of the nearest one, so that children lie between hyperplanes.
For each split point and each sibling child the tree keeps the range of distances from the point to the child's rows.
A query asks for rows whose inner product with it lies in a window; with the norms of a child's rows that is a window of
distances, an annulus around the query. A child is left out when, by the triangle inequality, the range of some sibling's
point shows that the annulus holds none of its rows. Leaves are compared exactly, in integers.

The tree is fitted on a bounded sample; every row is dealt to a leaf, and ranges and norms are those of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.cells import meet
from ..operators.retrieval import best_of, matrix_of

#: Sampled rows that the tree is fitted on and that give the first bounds; split points a node; sampled rows of a leaf.
FIT_ROWS, WAYS, LEAF = 16_384, 8, 96
#: Components beyond this would leave the integers that doubles hold.
MOST = 1 << 15
NONE = np.iinfo(np.int64).max
PROBE = "probe long, own long, label int, lo long, hi long, v array<int>"


def squares(v: np.ndarray) -> np.ndarray:
    return (v * v).sum(-1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all of b; whole numbers, exact in doubles."""
    return np.maximum(0, squares(a)[:, None] + squares(b)[None] - 2 * (a @ b.T))


@dataclass
class Tree:
    """Node k has the points first[k] .. first[k + 1]; child: of each point a node, or a leaf n as -1 - n."""

    points: np.ndarray
    first: list[int] = field(default_factory=list)
    child: list[int] = field(default_factory=list)
    leaves: int = 0
    low: dict[int, np.ndarray] = field(default_factory=dict)
    high: dict[int, np.ndarray] = field(default_factory=dict)
    norms: np.ndarray | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, ways: int = WAYS, leaf: int = LEAF, seed: int = 3) -> Tree:
        """Split points are picked far from each other, as the next farthest of a few times as many random rows."""
        rng, tree, points = np.random.default_rng(seed), cls(np.zeros((0, sample.shape[1]))), []
        todo: list[tuple[np.ndarray, int]] = [(np.arange(len(sample)), -1)]
        while todo:
            rows, above = todo.pop(0)
            some = rng.permutation(rows)[: 4 * ways]
            chosen, far = [], np.full(len(some), np.inf)
            while len(rows) > leaf and len(chosen) < ways and far.max(initial=0) > 0:
                chosen.append(some[int(far.argmax())])
                far = np.minimum(far, squared(sample[some], sample[chosen[-1:]])[:, 0])
            if len(chosen) < 2 and above >= 0:
                tree.child[above] = -1 - tree.leaves
                tree.leaves += 1
                continue
            chosen = chosen if len(chosen) > 1 else list(rows[:1])  # a root that is not split has one child
            if above >= 0:
                tree.child[above] = len(tree.first)
            tree.first.append(len(points))
            own = squared(sample[rows], sample[chosen]).argmin(1)
            for k, row in enumerate(chosen):
                points.append(sample[row])
                tree.child.append(0)
                if len(chosen) > 1:
                    todo.append((rows[own == k], len(points) - 1))
                else:
                    tree.child[-1], tree.leaves = -1 - tree.leaves, tree.leaves + 1
        tree.first.append(len(points))
        tree.points = np.array(points, np.float64)
        return tree

    def walk(self, v: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], tuple[float, float]]]:
        """Each row's leaf, and (least, most) by (point, sibling): the squared distances from the point to the sibling's
        rows; by (-1, sibling) their squared norms.
        """
        leaf, met, size = np.zeros(len(v), np.int32), {}, squares(v)
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            lo, hi = self.first[node], self.first[node + 1]
            d = squared(v[rows], self.points[lo:hi])
            own = d.argmin(1)
            for j in range(hi - lo):
                mine = own == j
                if not mine.any():
                    continue
                least, most = d[mine].min(0), d[mine].max(0)
                met |= {(lo + i, lo + j): (least[i], most[i]) for i in range(hi - lo)}
                met[-1, lo + j] = size[rows[mine]].min(), size[rows[mine]].max()
                if self.child[lo + j] < 0:
                    leaf[rows[mine]] = -1 - self.child[lo + j]
                else:
                    todo.append((self.child[lo + j], rows[mine]))
        return leaf, met

    def keep(self, ranges: list[tuple[int, int, float, float]]) -> None:
        """Takes the ranges of all rows, as distances; a child without rows has none."""
        n = len(self.points)
        self.norms = np.array([[np.inf] * n, [-np.inf] * n])
        for node in range(len(self.first) - 1):
            k = self.first[node + 1] - self.first[node]
            self.low[node], self.high[node] = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        node_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        for i, j, least, most in ranges:
            if i < 0:
                self.norms[:, j] = least, most
            else:
                node = int(node_of[j])
                at = i - self.first[node], j - self.first[node]
                self.low[node][at], self.high[node][at] = np.sqrt(least), np.sqrt(most)

    def reached(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that can hold a row whose inner product with the query is from lo to hi."""
        out, size = [(np.zeros(0, np.int64), np.zeros(0, np.int32))], squares(q)
        todo = [(0, np.flatnonzero(lo <= hi))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            a, b = self.first[node], self.first[node + 1]
            d = np.sqrt(squared(q[rows], self.points[a:b]))
            for j in range(b - a):
                low, high, (small, large) = self.low[node][:, j], self.high[node][:, j], self.norms[:, a + j]
                if small > large:
                    continue
                inner = np.sqrt(np.maximum(0, size[rows] + small - 2 * hi[rows])) - 1e-6
                outer = size[rows] + large - 2 * lo[rows]
                nearest = np.maximum(d - high, low - d).max(1)
                farthest = (d + high).min(1)
                stays = (outer >= 0) & (nearest <= np.sqrt(np.maximum(0, outer)) + 1e-6) & (farthest >= inner)
                if self.child[a + j] < 0:
                    out.append((rows[stays], np.full(int(stays.sum()), -1 - self.child[a + j], np.int32)))
                else:
                    todo.append((self.child[a + j], rows[stays]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def fitting(labels: np.ndarray, ids: np.ndarray, own_label: np.ndarray, own: np.ndarray, score: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool) -> np.ndarray:
    """Which rows (columns) each probe may take: of its label or of another, not itself, inside its window."""
    like = labels[None] == own_label[:, None]
    return (like if same else ~like) & (ids[None] != own[:, None]) & (score >= lo[:, None]) & (score <= hi[:, None])


class HyperplaneIndex:
    """Rows (uid, id, label, v) of integer vectors in the leaves of a tree."""

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(FIT_ROWS).select("id", "label", "v").toArrow()
        self.empty = not len(sample)
        if self.empty:
            return
        v = matrix_of(sample.column("v"))
        tree = Tree.fit(v)
        fitted = spark.sparkContext.broadcast(tree)  # at most FIT_ROWS points

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, _ = fitted.value.walk(matrix_of(pa.chunked_array([batch.column("v")])).reshape(len(batch), -1))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["cell", *batch.schema.names])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_met: dict[tuple[int, int], tuple[float, float]] = {}
            for batch in batches:
                for key, (least, most) in fitted.value.walk(matrix_of(pa.chunked_array([batch.column("v")])).reshape(len(batch), -1))[1].items():
                    a, b = all_met.get(key, (np.inf, -np.inf))
                    all_met[key] = min(a, least), max(b, most)
            columns = [[key[0] for key in all_met], [key[1] for key in all_met], [float(a) for a, _ in all_met.values()], [float(b) for _, b in all_met.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["i", "j", "least", "most"])

        self.rows = rows.select("uid", "id", "label", "v").mapInArrow(deal, "cell int, uid long, id long, label int, v array<int>").checkpoint()
        # at most WAYS rows for each point of the tree
        met = self.rows.select("v").mapInArrow(ranges, "i int, j int, least double, most double").groupBy("i", "j").agg(F.min("least"), F.max("most")).collect()
        tree.keep([tuple(r) for r in met])
        self.sent = spark.sparkContext.broadcast((tree, sample.column("id").to_numpy(), sample.column("label").to_numpy(), v))

    def search(self, probes: DataFrame, k: int, same: bool) -> DataFrame:
        """(probe, id, score, rank): the k highest scores from lo to hi among rows of the probe's label, or of others."""
        sent = self.sent

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, ids, labels, sample = sent.value
            for batch in batches:
                if not len(batch):
                    continue
                q = matrix_of(pa.chunked_array([batch.column("v")]))
                own, label, lo, hi = (batch.column(c).to_numpy() for c in ("own", "label", "lo", "hi"))
                # the kth score inside the sample is a lower bound of the kth among all rows
                score = q @ sample.T
                score[~fitting(labels, ids, label, own, score, lo, hi, same)] = -np.inf
                if score.shape[1] >= k:
                    bound = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    lo = np.where(np.isfinite(bound), np.maximum(lo, np.nan_to_num(bound, neginf=0)), lo).astype(np.int64)
                row, leaf = tree.reached(q, lo, hi)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *(pa.array(lo[row]) if n == "lo" else taken.column(n) for n in batch.schema.names)], names=["cell", *batch.schema.names])

        def compare(rows: pa.Table, probes: pa.Table) -> pa.Table:
            own, label, lo, hi, probe = (probes.column(c).to_numpy() for c in ("own", "label", "lo", "hi", "probe"))
            ids = rows.column("id").to_numpy()
            score = matrix_of(probes.column("v")) @ matrix_of(rows.column("v")).T
            fits = fitting(rows.column("label").to_numpy(), ids, label, own, score, lo, hi, same)
            row, found, far = best_of(np.where(fits, -score, np.inf), ids, k)
            there = np.isfinite(far)
            return pa.table({"probe": probe[row[there]], "id": found[there], "score": (-far[there]).astype(np.int64)})

        names = [c.split()[0] for c in PROBE.split(", ")]
        placed = probes.select(*names).mapInArrow(leaves, f"cell int, {PROBE}").checkpoint()
        found = meet(self.rows, "uid", placed, "probe", compare, "probe long, id long, score long", most_rows=4_096, most_probes=2_048)
        rank = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(256 * x), a null id as the largest number.

    Rows without label or vector, with a null, infinite or NaN component, or an empty vector are left out; so are those
    whose vector is not as long as most rows' (of equals the shortest). A component beyond MOST is an error.
    """
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(NONE))).alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", finite))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("x") == (sizes[0]["size"] if sizes else 0))
    far = F.exists("x", lambda x: F.abs(x) > MOST)
    v = F.when(far, F.raise_error(F.lit(f"a component is beyond {MOST}"))).otherwise(F.transform("x", lambda x: F.floor(256 * x).cast("int")))
    return rows.select("id", "label", v.cast("array<int>").alias("v"))


def hard_negatives(embeddings: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by `every`; an anchor's positives are its n_positives first other rows of
    the same label. For each the first n_negatives rows of another label whose score is from `percent` per cent of the positive's
    to the positive's. Scores are integer inner products, ties go to the smaller vec_id (null last).

    Other rows are those of another vec_id. Anchors that repeat a vec_id each give their rows; a null vec_id is no anchor's, but may
    be found. A positive score below 0 has an empty window. An empty table gives an empty one.
    """
    spark = embeddings.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = whole_vectors(embeddings).withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    index = HyperplaneIndex(rows)
    if index.empty:
        return spark.createDataFrame([], out)
    anchors = rows.where((F.col("id") % every == 0) & (F.col("id") != int(NONE)))
    probes = anchors.select(F.col("uid").alias("probe"), F.col("id").alias("own"), "label", F.lit(-(1 << 52)).alias("lo"), F.lit(1 << 52).alias("hi"), "v")
    positives = index.search(probes, n_positives, True).withColumnsRenamed({"id": "positive_id", "score": "positive_score", "probe": "uid"})
    pairs = positives.join(anchors, "uid").withColumn("probe", F.col("uid") * n_positives + F.col("rank") - 1).drop("rank", "uid").checkpoint()
    windows = pairs.select("probe", F.col("id").alias("own"), "label", F.ceil(F.col("positive_score") * percent / 100.0).cast("long").alias("lo"), F.col("positive_score").alias("hi"), "v")
    found = index.search(windows.where("lo <= hi"), n_negatives, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    known = lambda c: F.nullif(F.col(c), F.lit(int(NONE))).alias(c)
    return found.join(pairs.select("probe", F.col("id").alias("anchor_id"), "positive_id", "positive_score"), "probe").select(
        "anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"
    )
