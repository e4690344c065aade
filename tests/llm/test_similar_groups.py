"""Groups of texts alike on their five-word shingles, against all pairs compared by hand."""

from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cityjobs.llm import simhash
from cityjobs.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string"
similar_candidates = simhash.similar_candidates


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(rows):
    sets, parent = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or x and y and len(x & y) >= 0.8 * len(x | y):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(3000)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    bases = [prose(int(rng.integers(60, 400))) for _ in range(60)]
    out = [(i, " ".join(w)) for i, w in enumerate(bases)]
    for i in range(240):  # copies with up to one word in fifty changed; the first text has many
        words = list(bases[0 if i < 120 else int(rng.integers(60))])
        for at in rng.integers(0, len(words), int(rng.integers(0, len(words) // 50 + 1))):
            words[at] = "changed"
        out.append((1000 + i, " ".join(words).title() if i % 3 else "\n".join(words)))
    out += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "One"), (2005, "one two"), (2006, "long " * 20000)]
    return out


def test_groups_equal_all_pairs(spark, rows):
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    want = slow_groups(rows)
    assert set(got) == set(want)
    # never more than truly alike; nearly all of those, as a pair beyond the bits is no candidate
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_repeated_ids_other_columns_and_nothing(spark):
    prepare(spark)
    text = "a repeated row of seven plain words"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, text, "y"), (3, None, None)], SCHEMA).withColumn("n", F.lit(7)).withColumn("fp", F.lit("own"))
    found = simhash.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]
    assert len(simhash.similar_groups(docs).collect()) == 4
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_cells_yield_all_links_or_stars_where_dense(monkeypatch):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    fps += [fps[0] ^ 1 << k for k in range(60)]  # a dense group around the first
    fps += [fps[5] ^ 3, fps[6] ^ 7]
    rows = sorted((0 if k == 0 or k >= 40 and k < 100 else k % 40 + 1 if k < 40 else k - 94, 0, 0, f, k, 100) for k, f in enumerate(fps))
    columns = [[r[c] for r in rows] for c in range(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 7], pa.int64()) for c in columns], names=list("kijfdn")) for lo in range(0, len(rows), 7)]

    def links(block):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
        return {pair for b in simhash.near_in_cells(iter(batches), 8, 0.8) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}

    whole = links(1 << 16)
    assert whole == links(64)
    assert {a for a, b in whole if b is None} == {0, *range(40, 100)}  # for the second turn
    whole = {pair for pair in whole if pair[1] is not None}
    assert all((0, k) in whole for k in range(40, 100))
    assert {(5, 100), (6, 101)} <= whole and len(whole) <= 2 * 61 + 2


def test_no_link_left_aside_in_the_first_turn_is_lost(spark, rows, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(simhash, "similar_candidates", partial(simhash.similar_candidates, ample=0))
    monkeypatch.setattr(simhash, "thinned", lambda found: found.where("a % 3 = 0"))
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == slow_groups(rows)


def test_joins_of_a_cell_are_a_forest_and_exact():
    rng = np.random.default_rng(12)
    base = np.sort(rng.choice(1 << 40, 400, replace=False).astype(np.uint64))
    sets = []
    for _ in range(60):  # pairs a little below and above the similarity
        other = rng.choice(1 << 40, int(rng.integers(10, 90))).astype(np.uint64)
        sets.append(np.unique(np.concatenate([rng.choice(base, 400 - len(other), replace=False), other])))
    part = np.arange(60)
    links = simhash.join_parts(part, sets, 0.8)
    alike = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert 10 < len(alike) < 1700 and len(links) < 60

    def groups(pairs):
        label = np.arange(60)
        for a, b in pairs:
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    assert groups(links) == groups(alike)
    batches = []
    for lo in range(0, 60, 7):  # two cells, cut anywhere
        some = range(lo, min(60, lo + 7))
        batches.append(pa.RecordBatch.from_arrays([pa.array([int(k >= 30) for k in some]), pa.array([0] * len(some)), pa.array([0] * len(some)), pa.array(list(some)), pa.array([sets[k].view(np.int64) for k in some], pa.list_(pa.int64()))], names=list("kijpg")))
    found = [pair for b in simhash.joins_in_cells(iter(batches), 0.8) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert groups(found) == groups([(a, b) for a, b in alike if (a < 30) == (b < 30)])


def test_copies_with_blocks_appended_or_removed_are_grouped(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(3000)]
    rows = []
    for k in range(120):
        words = list(rng.choice(vocabulary, int(rng.integers(100, 400))))
        more = int(len(words) * rng.uniform(0.05, 0.23))
        copy = words[more * 4 // 5 :] if k % 2 else [*words, *rng.choice(vocabulary, more)]
        rows += [(k, " ".join(words), "x"), (1000 + k, " ".join(copy), "x")]
    sets = {i: shingle_set(t) for i, t, _ in rows}
    likeness = [len(sets[k] & sets[1000 + k]) / len(sets[k] | sets[1000 + k]) for k in range(120)]
    assert min(likeness) < 0.82 and max(likeness) > 0.94 and sum(x >= 0.8 for x in likeness) > 100
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == slow_groups([(i, t) for i, t, _ in rows])


def test_large_cells_lose_no_pair_beyond_the_bits(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in range(200)]
    rows = [(0, " ".join(words), "x")]
    rows += [(k, " ".join([*words, *(f"n{x}" for x in rng.integers(0, 100000, int(rng.integers(5, 60))))]), "x") for k in range(1, 90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = slow_groups([(i, t) for i, t, _ in rows])
    for split in (1024, 20):
        monkeypatch.setattr(simhash, "similar_candidates", partial(similar_candidates, split=split, whole=4))
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()} == want


def test_components_of_fingerprints_meet_without_bands_and_are_verified(spark, monkeypatch, rows):
    prepare(spark)
    monkeypatch.setattr(simhash, "bands", lambda grams: np.zeros(0, np.int64))
    words = [f"w{x}" for x in range(400)]
    close = [(k, " ".join([*words[:at], "other", *words[at + 1 :]]), "x") for k, at in enumerate((5, 90, 200, 390))]
    prints = {k: simhash.fingerprint(t.encode(), 4) for k, t, _ in close}
    assert len(set(prints.values())) > 1
    docs = spark.createDataFrame(close, SCHEMA)
    linked = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == linked and len(set(got.values())) < 4
    # one component of all texts, alike or not: what comes out is verified
    monkeypatch.setattr(simhash, "fingerprint", lambda text, width: 0)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == slow_groups(rows)
