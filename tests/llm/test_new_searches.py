"""Line runs, ranked search and hard negatives against brute force."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cityjobs.llm import hyperplane_tree, line_runs, queries, ranked_blocks
from cityjobs.llm.common import prepare

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def slow_lines(texts, least):
    cut = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in cut for k in {key(x) for x in lines} if k)
    out = []
    for lines in cut:
        kept = [x for x in lines if n[key(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def odd_texts():
    texts = ["Menu\nIch\n\n" + str(i) for i in range(9)] + [" MENU \t", "menu\x0b", "Ämter", "ämter", None, None, "", "\n", "\n\n", "a\r\nb", "menu\nmenu\nMenu\n"]
    texts += ["ZÜRICH\nx"] * 6 + ["zÜrich\n" * 3] * 4 + ["zürich"] * 2 + ["\x1cmenu", "a" * 50_000 + "\n" + "b\n" * 5_000]
    return texts + ["only menu \nmenu"]


def test_lines_that_many_rows_hold_go(spark):
    prepare(spark)
    texts = odd_texts()
    # a repeated doc_id, null ids and a clashing column
    ids = [None if k % 9 == 5 else k // 2 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, line string, n long")
    want = sorted(((str(i), *x) for i, x in zip(ids, slow_lines(texts, 10))))
    for parts in (1, 3):
        batches = [docs] if parts == 1 else [docs.where(f"pmod(hash(text), 3) = {k}") for k in range(3)] + [docs.limit(0)]
        got = line_runs.drop_common_lines(docs, batches, 10).collect()
        assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got) == want
    assert line_runs.drop_common_lines(docs.limit(0)).count() == 0
    assert line_runs.batches_of(docs) == [docs]


def test_more_common_lines_than_are_sent(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(line_runs, "COMMON_SENT", 1)
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_runs.drop_common_lines(docs, None, 2).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == [(i, *x) for i, x in enumerate(slow_lines(texts, 2))]


def test_levels_of_runs(spark):
    """A run on each level that a bit of the number of batches stands for; what is common already is counted no more."""
    prepare(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    runs = line_runs.LineRuns(spark, 3, buckets=4)
    batches = [spark.createDataFrame([(f"x{k % 2}\ny\ny",), (None,)], "text string") for k in range(7)]
    for k, batch in enumerate(batches, 1):
        runs.add(batch)
        assert [bool(x) for x in runs.levels] == [bool(k >> b & 1) for b in range(k.bit_length())]
    first = spark.table(runs.names()[-1])
    assert {r["n"] for r in first.where("common").collect()} == {4}  # y in the first four batches: no batch knew it as common
    assert first.select("line").collect() and not spark.table(runs.names()[0]).where("common").collect()
    hashed = {hashlib.md5(x).digest() for x in (b"x0", b"x1", b"y")}
    plan = runs.spark.table(runs.names()[0]).select("line", "n").hint("merge").join(spark.table(runs.names()[1]).select("line", "n"), "line", "full_outer")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {bytes(r["line"]) for r in runs.common().collect()} == hashed
    left = spark.sql(f"show tables in {runs.database}").count()
    assert left == 1
    runs.close()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_registered_lines_query(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, (t, n, d)) in zip(rows, slow_lines(rows.values(), 10))}
    got = queries.QUERIES["op12_line_runs"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got} == want


def slow_negatives(rows, every, n, m, percent):
    rows = [(NONE if i is None else i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, dot = [], lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in rows:
        if a == NONE or a % every:
            continue
        scored = sorted((-dot(v, w), b, label == other) for b, other, w in rows if b != a)
        for ps, p, _ in [x for x in scored if x[2]][:n]:
            fit = [(s, b) for s, b, like in scored if not like and percent * -ps <= 100 * -s <= 100 * -ps][:m]
            out += [(a, p, k, b, -ps, -s) for k, (s, b) in enumerate(fit, 1)]
    return [tuple(None if x == NONE else x for x in r) for r in out]


NONE = int(hyperplane_tree.NONE)
VECTORS = "vec_id long, label int, embedding array<float>, cell int, v string"


def vector_rows(n, clusters):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(clusters, 8))
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in centres[i % clusters] + rng.normal(size=8) * 0.05]) for i in range(n)]
    rows += [(n + k, k % 3, rows[7][2]) for k in range(40)]  # copies of one vector
    rows += [(100 * n, None, rows[0][2]), (101 * n, 1, None), (102 * n, 1, [1.0, None] * 4), (103 * n, 1, [float("nan")] * 8), (104 * n, 1, [float("inf")] * 8), (105 * n, 1, []), (None, 1, rows[20][2]), (None, 2, rows[21][2])]
    rows += [(20, 2, rows[3][2]), rows[40]]  # a repeated id, a repeated row
    return rows


@pytest.mark.parametrize("clusters", [1, 12])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, clusters):
    prepare(spark)
    monkeypatch.setattr(hyperplane_tree, "FIT_ROWS", 120)
    monkeypatch.setattr(hyperplane_tree, "LEAF", 8)
    rows = vector_rows(300, clusters)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = hyperplane_tree.hard_negatives(table, 10, 4, 3, 80)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = slow_negatives(rows, 10, 4, 3, 80)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 100
    assert hyperplane_tree.hard_negatives(table.limit(0)).count() == 0
    assert hyperplane_tree.hard_negatives(table.where("vec_id = 10")).count() == 0


def test_tree_leaves_out_leaves_but_no_row():
    rng = np.random.default_rng(9)
    v = np.floor(256 * (rng.normal(size=(40, 6))[rng.integers(40, size=3000)] + 0.05 * rng.normal(size=(3000, 6))))
    tree = hyperplane_tree.Tree.fit(v[:1000], ways=5, leaf=20)
    leaf, met = tree.walk(v)
    tree.keep([(*k, *x) for k, x in met.items()])
    q, seen = v[::30], 0
    score = q @ v.T
    lo, hi = np.percentile(score, 97, axis=1), np.percentile(score, 99, axis=1)
    row, found = tree.reached(q, lo, hi)
    for k in range(len(q)):
        own = set(found[row == k])
        assert set(leaf[(score[k] >= lo[k]) & (score[k] <= hi[k])]) <= own
        seen += len(own)
    assert tree.leaves > 40 and seen < 0.6 * tree.leaves * len(q)


def test_far_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        hyperplane_tree.whole_vectors(spark.createDataFrame([(1, 1, [1e9], 1, "x")], VECTORS)).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(str(x) for x in r) for r in found.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want


def slow_ranking(docs, items, most):
    """By the contract's words, document by document."""
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    words = lambda t: term.findall((t or "").translate(LOWER))
    cut = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, total = sum(size > 0 for *_, size in cut), sum(size for *_, size in cut)
    out = []
    for item, text in items:
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c, _ in cut) + 1))) for t in set(words(text))}
        scored = []
        for i, counts, size in cut:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(weight[t] * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in words(text))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=str_last)[:most], 1)]
    return out


def str_last(x):
    return x[0], x[1], x[2] or 0


@pytest.mark.parametrize("limits", ["whole", "cut"])
def test_ranked_documents_are_those_of_all(spark, monkeypatch, limits):
    prepare(spark)
    if limits == "cut":
        for name, value in (("QUERIES_AT_ONCE", 2), ("TERMS_AT_ONCE", 12), ("SHARD_DOCS", 60), ("BLOCK", 4), ("SAMPLE", 40)):
            monkeypatch.setattr(ranked_blocks, name, value)
    rng = np.random.default_rng(5)
    names = [f"w{k}" for k in range(60)] + ["Über", "ÜBER", "naïve", "字", "x1"]
    text = lambda: " ".join(rng.choice(names, size=int(rng.integers(1, 40)), p=np.arange(65, 0, -1) / (65 * 66 / 2)))
    docs = [(k, text()) for k in range(300)] + [(k, "w1 W1, w3.w40-x1 über\x7fw1") for k in range(300, 340)]
    docs += [(None, "w5 w6"), (None, None), (341, ""), (342, " .,"), (343, "w7 " * 20_000), (5, "w5 w6"), (5, "w5 w6")]
    items = [(k, text()) for k in range(12)] + [(12, None), (13, "..."), (14, "nowhere"), (None, "w1 w40"), (3, "w61 ÜBER über"), (15, "w1 " * 50)]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, q int").repartition(3)
    i = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    got = ranked_blocks.ranked(d, i, 7).collect()
    want = slow_ranking(docs, items, 7)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 90
    assert ranked_blocks.ranked(d, i.limit(0)).count() == ranked_blocks.ranked(d.limit(0), i).count() == 0


def test_blocks_are_skipped_where_documents_differ():
    """Documents about five subjects: a query on one of them skips blocks of its common terms, and its best are those of all."""
    rng = np.random.default_rng(6)
    n, n_terms, most = 3_000, 400, 5
    subject = rng.integers(5, size=n)
    found = [np.unique(np.concatenate([rng.integers(40, size=6), 100 + 15 * s + rng.integers(15, size=14)])) for s in subject]
    at, terms = np.cumsum([0, *map(len, found)]), np.concatenate(found)
    values = rng.integers(500_000, 900_000, size=len(terms))
    weighed = np.zeros((n_terms, 8))
    for q in range(8):
        weighed[rng.integers(40, size=3), q] = 2_500
        weighed[100 + 15 * (q % 5) + rng.permutation(15)[:5], q] = 1_500
    shard = ranked_blocks.Shard(at, terms, values, n_terms)
    scores = shard.dense.astype(float) @ weighed
    least = -np.sort(-scores[::4], axis=0)[most - 1]
    index = ranked_blocks.index_of(at, terms, values, weighed, least)
    best = ranked_blocks.Best(least, most)
    bounded, read = ranked_blocks.searched(shard, index, weighed, np.arange(n), best)
    for q in range(8):
        want = np.lexsort((np.arange(n), -scores[:, q]))[:most]
        assert list(best.rows[q][1]) == list(want) and list(best.rows[q][0]) == list(scores[want, q])
    assert read < 0.75 * bounded and len(index["list_term"]) < np.count_nonzero(weighed.any(1))
    for k, t in enumerate(index["list_term"]):  # a block's summary is the maximum of its documents, coordinate by coordinate
        first, last = index["list_at"][k : k + 2]
        coords = index["coords"][index["coord_at"][k] : index["coord_at"][k + 1]]
        maxima = index["maxima"][index["maxima_at"][k] : index["maxima_at"][k + 1]].reshape(last - first, -1)
        blocks = [index["postings"][index["block_at"][b] : index["block_at"][b + 1]] for b in range(first, last)]
        assert sorted(np.concatenate(blocks)) == list(np.flatnonzero(shard.dense[:, t]))
        assert all(np.array_equal(m, shard.dense[np.ix_(b, coords)].max(0)) for m, b in zip(maxima, blocks))


def test_files_of_the_index_stay_small(spark, tmp_path, monkeypatch):
    """A task that builds many shards writes many files, so that a search takes in a few at a time; copies of an item are one query."""
    prepare(spark)
    monkeypatch.setattr(ranked_blocks, "SHARD_DOCS", 16)
    monkeypatch.setattr(ranked_blocks, "scratch", lambda _, name: str(tmp_path / name))
    d = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "concat('w', id % 7, ' w', id % 11, ' w', id % 13) as text")
    i = spark.createDataFrame([(k, t) for k in range(6) for t in ("w1 w2", "w3 w5 W3")], "item_id long, text string")
    assert [q.ids for q in ranked_blocks.blocks_of(i)] == [[list(range(6))] * 2]
    got = ranked_blocks.ranked(d, i, 5).groupBy("item_id").count().collect()
    assert {(r["item_id"], r["count"]) for r in got} == {(k, 10) for k in range(6)}
    files = list((tmp_path / "posting_blocks").glob("*.parquet"))
    assert len(files) == 13 and spark.read.parquet(str(tmp_path / "posting_blocks")).count() == 25
