"""Work in proportion: pruned reads, dense cells, long keyword lists, buckets that differ."""

import datetime
import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityjobs.operators import audit, chunks, keywords, opendata, pages, retrieval, urls
from cityjobs.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_filter_prunes_folders_of_chunks(spark, tmp_path, fmt):
    root = str(tmp_path / "kb")
    df = spark.range(60).selectExpr("concat('d', id, '_0000') as chunk_id", "concat('d', id) as doc_id", "case when id % 3 = 0 then 'law' else 'admin' end as category", "concat('s', id % 2) as source")
    files.write_chunks(df, root, fmt)
    found = files.read_chunks(spark, root, fmt)
    law = found.where("category = 'law' and source = 's1'")
    assert "PartitionFilters: [isnotnull(category" in plan_of(law)
    read = {r[0] for r in law.select(F.input_file_name()).distinct().collect()}
    assert law.count() == 10 and read and all("category=law/source=s1" in f for f in read)
    assert sorted((r["chunk_id"], r["category"], r["source"]) for r in found.collect()) == sorted(map(tuple, df.select("chunk_id", "category", "source").collect()))


def test_plain_folders_are_named_in_the_path(spark, tmp_path):
    for category, source in (("law", "a"), ("admin", "b")):
        (tmp_path / category / source).mkdir(parents=True)
        (tmp_path / category / source / "x.jsonl").write_text(f'{{"chunk_id": "{source}_0000", "doc_id": "{source}"}}\n')
    (tmp_path / "top.jsonl").write_text('{"chunk_id": "no"}\n')
    rows = lambda **k: sorted((r["chunk_id"], r["category"], r["source"]) for r in files.read_plain_chunks(spark, str(tmp_path), **k).collect())
    assert rows() == [("a_0000", "law", "a"), ("b_0000", "admin", "b")]
    assert rows(category="law") == [("a_0000", "law", "a")]
    (tmp_path / "admin" / "b" / "x.jsonl").write_text("no json")  # not read for the other category
    assert rows(category="law") == [("a_0000", "law", "a")]


def metres(a, b):
    (y1, x1), (y2, x2) = np.radians(a), np.radians(b)
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_places_in_a_dense_quarter(spark, monkeypatch):
    """Most places within a few metres, some at one spot, others far out: the same as of all pairs, with small cells."""
    monkeypatch.setattr(opendata, "PLACES_IN_CELL", 12)
    rng = np.random.default_rng(3)
    dense = [(47.37 + rng.normal() * 2e-4, 8.54 + rng.normal() * 2e-4) for _ in range(500)]
    pois = dense + [(47.37, 8.54)] * 40 + [(47.37 + rng.normal() * 0.05, 8.54 + rng.normal() * 0.05) for _ in range(150)] + [(None, 8.5)]
    points = dense[:30] + [(47.37, 8.54)] + [(47.37 + rng.normal() * 0.08, 8.54 + rng.normal() * 0.08) for _ in range(40)] + [(60.0, 8.0), (47.0, None)]
    a = spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), p)) for i, p in enumerate(points)], "point_id long, lat double, lon double")
    b = spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), p)) for i, p in enumerate(pois)], "poi_id long, lat double, lon double")
    got = sorted(map(tuple, opendata.poi_nearest(a, b, 3_000, 4).collect()))
    want = []
    for i, p in enumerate(points):
        if None not in p:
            near = sorted((metres(p, q), j) for j, q in enumerate(pois) if None not in q and metres(p, q) <= 3_000)
            want += [(i, j, int(m), rank) for rank, (m, j) in enumerate(near[:4], 1)]
    assert got == sorted(want) and len(want) > 200
    assert opendata.poi_nearest(a, b.limit(0), 3_000, 4).count() == opendata.poi_nearest(a.limit(0), b, 3_000, 4).count() == 0


def test_long_keyword_lists_give_what_short_ones_do(spark, monkeypatch):
    texts = ["Die Schule über dem Wald", "schule", "für alle no más", "", None, "waldschule Schulen und wald "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    words = ["schule", "wald", "über", "no más", "für", "schul", "ü", "", "alle", "wald"]

    def found():
        tags = [pages.tag_keywords(F.lit("Der Wald"), F.col("text"), words, **k) for k in ({}, {"mode": "word", "suffix": "n"}, {"mode": "word", "suffix": ""}, {"fold": True, "ordered": True}, {"fixed": F.array(F.lit("wald"), F.lit("x"))})]
        label = urls.first_keyword_label(F.col("text"), [("wald", "W"), ("schule", "S"), ("wald", "V"), ("alle", "A")], "none")
        return df.select("id", *tags, label).orderBy("id").collect()

    short = [tuple(r) for r in found()]
    for module in (pages, urls):
        monkeypatch.setattr(module, "FEW", 2)
    assert [tuple(r) for r in found()] == short and short[0][1] == ["schule", "wald", "über", "schul", "ü", ""]
    names = spark.createDataFrame([(1, "ab_abc"), (2, "zz"), (3, None), (4, "bc")], "id int, name string")
    keys = spark.createDataFrame([("abc",), ("ab_",), ("bc",), (None,)], "key string")
    assert sorted((r["id"], r["key"]) for r in pages.match_longest_key(names, "name", "id", keys).collect()) == [(1, "ab_"), (2, None), (3, None), (4, "bc")]
    monkeypatch.setattr(keywords, "LETTERS_SENT", 10)
    with pytest.raises(ValueError):
        keywords.scanned(F.col("text"), ["a" * 11], sorted, "array<int>")


def test_ten_thousand_keywords_cost_as_a_few():
    text = "die schule im wald und der see " * 40
    few, many = tuple(f"w{k}x" for k in range(20)), tuple(f"w{k}x" for k in range(10_000))
    took = []
    for words in (few, many):
        made = keywords.automaton(words)
        start = time.perf_counter()
        for _ in range(300):
            keywords.places_in(text, made, set())
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0]


def test_only_buckets_that_differ_meet(spark):
    day = lambda d: datetime.date(2025, 1, d)
    old = [(f"d{k}", day(1 + k % 20)) for k in range(400)]
    new = [(i, d) for i, d in old if i not in ("d5", "d77")]
    new = [(i, day(28) if i == "d100" else day(1) if i == "d119" else d) for i, d in new] + [("n1", day(2)), ("n2", day(3))]
    a, b = (spark.createDataFrame(rows, "doc_id string, updated_at date") for rows in (old, new))
    found = chunks.change_set(a, b.orderBy(F.desc("doc_id")), 64)
    want = {i: "unchanged" for i, _ in old} | {"d5": "deleted", "d77": "deleted", "d100": "changed", "n1": "new", "n2": "new"}
    got = found.collect()
    assert {r["doc_id"]: r["change"] for r in got} == want and len(got) == len(want)
    # the rows of the full outer join: those of six buckets, where a change is
    both = chunks.digests(a.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64))), 64).join(chunks.digests(b.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64))), 64).withColumnRenamed("digest", "other"), "bucket", "full_outer")
    assert both.where(~F.col("digest").eqNullSafe(F.col("other"))).count() <= 6
    assert chunks.change_set(a, a).where("change <> 'unchanged'").count() == 0
    assert {r["change"] for r in chunks.change_set(a.limit(0), a).collect()} == {"new"}


def test_sample_of_a_hot_stratum(spark):
    """n rows a stratum, all of a smaller one, by the hash's order alone; another seed gives another sample."""
    df = spark.range(3_000).selectExpr("id", "case when id < 2990 then 'hot' when id < 2998 then 'few' end as s").repartition(5)
    by_seed = {}
    for seed in (1, 2):
        found = [(r["s"], r["id"]) for r in audit.stratified_sample(df, "s", 20, "id", seed).collect()]
        want = {}
        for i in range(3_000):
            s = "hot" if i < 2990 else "few" if i < 2998 else None
            want.setdefault(s, []).append((hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i))
        assert sorted(found, key=str) == sorted(((s, i) for s, rows in want.items() for _, i in sorted(rows)[:20]), key=str)
        by_seed[seed] = found
    assert sorted(by_seed[1], key=str) != sorted(by_seed[2], key=str)


def test_embedding_with_an_encoder(spark):
    texts = ["abc", "", None, "b" * 10_000]

    def encoder(batch):
        return np.array([[t.count("a"), t.count("b")] for t in batch])

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["v"] for r in retrieval.embed(df, "t", encoder, "v").collect()}
    assert got[0] == pytest.approx([0.5**0.5] * 2) and got[1] == got[2] == [0, 0] and got[3] == [0, 1]
