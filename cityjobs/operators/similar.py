"""Near-duplicate texts by an exact set-similarity join.

Shingles are ordered by rarity. Two sets that are alike share one of their rarest few, so only texts with a common
shingle in these prefixes meet; sizes and places rule out most of those, and the rest are verified on whole sets.
Nothing is sampled, so no link is missed; equal sets are told by two 64-bit hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .urls import keep_checkpoints

#: Texts of one shingle that meet in one group, and shingles that a matrix of them holds at once.
PART, COLUMNS = 1_024, 4_096
#: Texts of a group that are compared one by one.
FEW = 12


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def shingles(words: Column, width: int = 5) -> Column:
    """Sorted distinct hashes of runs of `width` words; of all words where there are fewer; none without words. `words`
    should be a column of its own, as it is looked into once a shingle.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " ")))
    few = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.when(F.size(words) >= width, runs).otherwise(few)))


def prefix_size(size: Column, threshold: float) -> Column:
    """How many of the rarest must hold a common one of two sets that are alike. The slack is for binary fractions."""
    return size - F.ceil(size * threshold - 1e-9) + 1


def linked(tokens: list[np.ndarray], size: np.ndarray, place: np.ndarray, i: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of one group that are alike and whose first common shingle is the group's.

    tokens: each text's shared shingles, rarest first; place: where the group's shingle stands among them; i: the part
    of each text. Texts of different parts meet; with one part only all do.
    """
    flat, of = np.unique(np.concatenate(tokens), return_inverse=True)
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    before = np.concatenate([np.arange(len(t)) for t in tokens]) < np.repeat(place, [len(t) for t in tokens])
    shared, earlier = np.zeros((len(tokens),) * 2, np.float32), np.zeros((len(tokens),) * 2, np.float32)
    for lo in range(0, len(flat), COLUMNS):
        for out, some in ((shared, np.ones(len(of), bool)), (earlier, before)):
            mine = some & (of >= lo) & (of < lo + COLUMNS)
            m = np.zeros((len(tokens), min(COLUMNS, len(flat) - lo)), np.float32)
            m[row[mine], of[mine] - lo] = 1
            out += m @ m.T
    alike = shared >= threshold * (size[:, None] + size[None] - shared) - 1e-6
    apart = i[:, None] < i[None] if i.min() < i.max() else np.arange(len(i))[:, None] < np.arange(len(i))[None]
    return np.nonzero(alike & apart & (earlier == 0))


def few_linked(tokens: list[list[int]], size: list[int], place: list[int], part: list[int], threshold: float) -> list[int]:
    """The same for a group of a few texts, as the texts' places, two for each pair: cheap tests first."""
    out, apart = [], min(part) < max(part)
    for b in range(1, len(tokens)):
        for a in range(b):
            x, y = size[a], size[b]
            if apart and part[a] == part[b] or min(x, y) < threshold * max(x, y) - 1e-6:
                continue
            least = threshold * (x + y) / (1 + threshold) - 1e-6
            # if the group's shingle is their first common one, they share no more than it and what follows it in both
            if min(len(tokens[a]) - place[a], len(tokens[b]) - place[b]) < least or not set(tokens[a][: place[a]]).isdisjoint(tokens[b][: place[b]]):
                continue
            if len(set(tokens[a]).intersection(tokens[b])) >= least:
                out += [a, b]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of sorted rows cut between groups of equal keys, with where their groups begin and the last ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        columns = [whole.column(k).to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()]
        held = [whole.slice(cuts[-1])]
        if len(cuts) > 1:
            yield whole.slice(0, cuts[-1]), cuts
    if held:
        yield held[0], [0, len(held[0])]


def meeting(known: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """Of (_key, _text): (_key, a, b, n), two hashes of each text's set and its size; and the `a` of sets that share
    one of their first few shingles, in the order of the hashes, with another: any two sets that are alike do.

    Only these first few are sent around, as many as a prefix of the rarest has, so that the other steps have less to do.
    """
    sets = known.select("_key", words_of(F.col("_text")).alias("_words")).select("_key", shingles(F.col("_words"), width).alias("_set"))
    n = F.size("_set")
    first = F.slice("_set", F.lit(1), prefix_size(n, threshold).cast("int"))
    wide = sets.select("_key", F.xxhash64("_set").alias("a"), F.xxhash64(F.lit(7), "_set").alias("b"), n.alias("n"), F.when(n > 0, first).alias("_first")).checkpoint()
    of_shingle = W.partitionBy("t")
    seen = wide.select("a", F.explode("_first").alias("t")).withColumn("_lo", F.min("a").over(of_shingle)).withColumn("_hi", F.max("a").over(of_shingle))
    return wide.drop("_first").checkpoint(), seen.where("_lo < _hi").select("a").distinct().checkpoint()


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle files and checkpoints of steps that nothing
    refers to any more, as a heap with room is collected rarely.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(key, class, links), a row for each row: the smallest key of the rows with the same shingles, and how many other
    classes are alike by a Jaccard similarity of `threshold` or more. Copies are one class and are not paired.

    Texts without words (null ones too) are one class without links. Keys tell rows apart. A shingle that many texts
    have in their prefixes is cut into parts that meet two by two, in groups of bounded size; of a group only counts
    come out, at most one for each text, never its pairs. Classes that share none of their first shingles with another are set aside before, and their texts not looked at again.
    """
    spark = docs.sparkSession
    keep_checkpoints(spark)
    known = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows, met = meeting(known, threshold, width)
    let_go(spark)
    classes = rows.groupBy("a", "b").agg(F.min("_key").alias("class"), F.first("n").alias("n"))
    # of the texts only those of classes that meet another are cut into shingles again; the smaller side is held in memory
    asked = classes.join(met, "a", "left_semi").select("a", "n", F.col("class").alias("_key")).hint("shuffle_hash")
    own = known.join(asked, "_key").select("a", "n", words_of(F.col("_text")).alias("_words")).select("a", "n", shingles(F.col("_words"), width).alias("_set")).checkpoint()
    # keys that are repeated bring other texts too; before the checkpoint this test would split a text again for each shingle
    sets = own.where(F.xxhash64("_set") == F.col("a")).dropDuplicates(["a"]).checkpoint()
    del own
    let_go(spark)
    each = sets.select("a", "n", F.explode("_set").alias("t"))
    common = each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    # what only one class has is rarest of all: it fills the prefix first and links nothing
    shared = each.join(common, "t").groupBy("a", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("tokens"))
    room = prefix_size(F.col("n"), threshold) - (F.col("n") - F.size("tokens"))
    shared = shared.withColumn("room", room.cast("int")).where("room > 0").checkpoint()
    let_go(spark)
    prefixes = shared.select("a", F.posexplode(F.slice("tokens", F.lit(1), F.col("room"))).alias("place", "t")).checkpoint()
    parts = prefixes.groupBy("t").agg(F.ceil(F.count("*") / PART).alias("parts"), F.count("*").alias("members")).where("members > 1").drop("members")
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = prefixes.join(parts, "t").withColumn("part", part).withColumn("_o", other).select("t", F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), "part", "a", "place")
    # tokens come in last, as a class has them in each of its groups
    dealt = dealt.join(shared.drop("room"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, ["t", "i", "j"]):
            n, place, part, i, j = (batch.column(c).to_numpy() for c in ("n", "place", "part", "i", "j"))
            lists = batch.column("tokens")
            at, values = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            links = np.zeros(len(batch), np.int64)
            for a, z in zip(cuts, cuts[1:]):
                if z - a < 2 or i[a] != j[a] and (part[a:z] == part[a]).all():
                    continue
                if z - a <= FEW:
                    met = few_linked([values[x:y].tolist() for x, y in zip(at[a:z], at[a + 1 : z + 1])], n[a:z].tolist(), place[a:z].tolist(), part[a:z].tolist(), threshold)
                    for x in met:
                        links[a + x] += 1
                else:
                    x, y = linked([values[u:v] for u, v in zip(at[a:z], at[a + 1 : z + 1])], n[a:z], place[a:z], part[a:z], threshold)
                    links[a:z] += np.bincount(np.concatenate([x, y]), minlength=z - a)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(some)), pa.array(links[some])], names=["a", "links"])

    found = dealt.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j").mapInArrow(run, "a long, links long").groupBy("a").agg(F.sum("links").alias("links")).checkpoint()
    let_go(spark)
    linked_classes = classes.join(found, "a", "left").select("a", "b", "class", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(linked_classes, ["a", "b"]).select(F.col("_key").alias(key), "class", "links")
