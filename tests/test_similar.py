"""The near-duplicate join against all pairs."""

import pathlib

import numpy as np
import pytest

from cityjobs.operators import similar
from cityjobs.operators.urls import shared_folder


def slow(rows, threshold):
    """(key, class, links) by comparing all sets."""
    sets = {}
    for key, text in rows:
        w = (text or "").lower().split()
        sets[key] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    least = {}
    for key, s in sets.items():
        least[s] = min(key, least.get(s, key))
    links = {s: sum(len(s & o) >= threshold * len(s | o) for o in least if o != s) if s else 0 for s in least}
    return sorted((key, least[s], links[s]) for key, s in sets.items())


@pytest.mark.parametrize("part", [1_024, 7, 100])
@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_links_are_those_of_all_pairs(spark, monkeypatch, part, threshold):
    """Copies, near copies of every kind, a group of many near copies under common shingles, short and empty texts."""
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "COLUMNS", 50 if part == 7 else 4_096)
    monkeypatch.setattr(similar, "FEW", 0 if part == 100 else 12)
    rng = np.random.default_rng(part)
    word = lambda: f"w{rng.integers(400)}"
    texts = [None, "", " ", "one two", "ONE  two", "one two three four five", "one two three four six"]
    for _ in range(40):
        base = [word() for _ in range(int(rng.integers(5, 40)))]
        for _ in range(3):
            other = list(base)
            for _ in range(int(rng.integers(0, 3))):
                other[int(rng.integers(len(other)))] = word()
            texts.append(" ".join(other[: len(other) - int(rng.integers(0, 2))]))
    hot = [f"h{k}" for k in range(30)]
    texts += [" ".join([*hot, f"x{k}"]) for k in range(60)] + [" ".join([f"y{k}", *hot, "end"]) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, texts[20]), (1001, texts[-1])]
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in rows], "id long, text string, n int, class string").repartition(3)
    got = sorted(map(tuple, similar.near_duplicates(df, "id", "text", threshold).collect()))
    want = slow(rows, threshold)
    assert got == want and max(r[2] for r in want) >= 79
    assert similar.near_duplicates(df.limit(0), "id", "text").count() == 0


def test_candidates_of_a_group_come_out_as_counts(spark, monkeypatch):
    """A group of n texts that are all alike gives a row a text and group of parts, not n squared pairs."""
    monkeypatch.setattr(similar, "PART", 64)
    hot = " ".join(f"h{k}" for k in range(40))
    df = spark.range(500).selectExpr("id", f"concat('{hot} ', 'x', id) as text")
    found = similar.near_duplicates(df, "id", "text")
    assert {r["links"] for r in found.collect()} == {499}


def test_sets_that_meet_no_other_are_not_kept(spark):
    """Of texts without likeness only the first few shingles of each are written down, not their whole sets."""
    place = pathlib.Path(shared_folder(spark))
    size = lambda: sum(f.stat().st_size for f in place.rglob("part-*"))
    before = size()
    df = spark.range(300).selectExpr("id", "array_join(transform(sequence(1, 504), k -> concat('w', id, '_', k)), ' ') as text")
    df = df.unionByName(df.where("id < 2").selectExpr("id + 1000 as id", "concat(text, ' end') as text"))
    found = sorted(map(tuple, similar.near_duplicates(df, "id", "text").collect()))
    assert [r for r in found if r[2]] == [(0, 0, 1), (1, 1, 1), (1000, 1000, 1), (1001, 1001, 1)] and len(found) == 302
    assert size() - before < 302 * 500 * 8 / 2
