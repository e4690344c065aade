"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits. Its embedding is the vector of bit counts of the
segments. The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so a
pair within `max_bits` bits has embeddings within Manhattan distance `max_bits`. With the 32 axes in `blocks`
groups, such a pair agrees exactly on at least `blocks - max_bits` groups: every choice of that many groups is one
grid, and pairs meet in a cell of at least one of the grids. Inside a cell the Manhattan bound is tested first, the
fingerprints themselves after it.

Counts are held in unary (0 as 00, 1 as 01, 2 as 11), so that the Manhattan distance is the number of differing
bits of two embeddings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, let_go, utf8

LOW = 0x5555555555555555
BLOCK_ROWS = 1 << 16
PAIRS_AT_ONCE = 1 << 23
MARKS = 1024
SALTS = 32
FEW_KEYS = 1 << 17  # of 16 bytes each: as many as are broadcast
BANDS, BAND_ROWS = 24, 5
SEEDS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """Signed 64-bit SimHash of the lower-cased words' shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    at = [0, *np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()]
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, n, 1 << 15):
        some = b"".join([digest(joined[a : b - 1], 42) for a, b in zip(at[lo : min(n, lo + (1 << 15))], at[lo + width :])])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1)
        pad = -len(bits) % 255
        if pad:
            bits = np.concatenate([bits, np.zeros((pad, 64), np.uint8)])
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): null and wordless texts get 0. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 segments, in unary, as one long."""
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def embed(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW), np.uint64(1)
    high = fp >> one
    return ((fp | high) & low) | (((fp & high) & low) << one)


def grids(blocks: int, max_bits: int) -> list[int]:
    """Masks over embeddings, one for each choice of `blocks - max_bits` groups of axes."""
    groups = [int(sum(3 << (2 * int(axis)) for axis in part)) for part in np.array_split(np.arange(32), blocks)]
    return [sum(chosen) for chosen in combinations(groups, blocks - max_bits)]


def forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what a cell's links connect: fewer links than members, however dense the cell."""
    seen, label, out = embed(fp), np.arange(len(fp)), []
    for i in range(1, len(fp)):
        near = np.flatnonzero(np.bitwise_count(seen[:i] ^ seen[i]) <= max_bits)
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= max_bits]
        if len(near):
            roots, first = np.unique(label[near], return_index=True)
            out += [(int(near[k]), i) for k in first]
            label[: i + 1][np.isin(label[: i + 1], roots)] = roots[0]
            label[i] = roots[0]
    return out


def cell_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (grid, cell, i, j, fp), sorted: links among the rows of each cell part."""

    def links(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        fp = rows[4].view(np.uint64)
        sizes = np.diff(np.append(starts, rows.shape[1]))
        run = np.repeat(np.arange(len(starts)), sizes)
        size = sizes[run] if len(run) else run
        seen, a, b = embed(fp), [], []
        small = np.flatnonzero((size > 1) & (size <= 8))
        for d in range(1, 8):
            i = small[small + d < len(run)]
            i = i[run[i] == run[i + d]]
            i = i[np.bitwise_count(seen[i] ^ seen[i + d]) <= max_bits]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
            a.append(i)
            b.append(i + d)
        for r in np.flatnonzero(sizes > 8):
            pairs = np.array(forest(fp[starts[r] : starts[r] + sizes[r]], max_bits), np.int64).reshape(-1, 2)
            a.append(pairs[:, 0] + starts[r])
            b.append(pairs[:, 1] + starts[r])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(rows[4][a]), pa.array(rows[4][b])], names=["a", "b"])

    rest = np.zeros((5, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        starts = np.append(0, np.flatnonzero(np.any(rows[:4, 1:] != rows[:4, :-1], axis=0)) + 1)
        rest = rows[:, starts[-1] :]
        if len(starts) > 1:
            yield links(rows[:, : starts[-1]], starts[:-1])
    if rest.shape[1]:
        yield links(rest, np.array([0]))


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks whose cells hold about 64 of n fingerprints each, spread evenly: at 64 million 7, at 1,000 million 8."""
    blocks = max_bits + 2
    while blocks < 16 and n >> int(48 * (blocks - max_bits) / blocks) > 64:
        blocks += 1
    return blocks


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, split: int = 2048) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` within `max_bits` bits of each other.

    A cell with more than `split` members is cut into parts by hash, and every two parts meet in a task of their
    own: no task holds more than two parts, no pair is lost. A cell part yields fewer links than it has members.
    More `blocks` make more and finer grids (6: 15 grids of about 16 bits, 7: 35 of 20, 8: 70 of 24).
    """
    seen = embedding(F.col("fp"))
    cells = fps.select("fp", F.posexplode(F.array(*[seen.bitwiseAND(F.lit(signed(m))) for m in grids(blocks, max_bits)])).alias("grid", "cell"))
    hot = cells.groupBy("grid", "cell").count().where(F.col("count") > split)
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / split).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        cells.join(hot, ["grid", "cell"], "left")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        .repartition("grid", "cell", "i", "j")
        .sortWithinPartitions("grid", "cell", "i", "j", "fp")
    )
    return dealt.mapInArrow(lambda batches: cell_links(batches, max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that an edge (a, b) has, roots included; root is the component's smallest node.

    Alternates large and small stars until the edges no longer change. A node's smallest neighbour comes from a
    partial aggregate and a join, so a hub's neighbours never meet in one task.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        before, seen = seen, state(now)
        let_go(edges.sparkSession)
        if before == seen:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())  # a star has no row of its centre


def fingerprint_roots(fps: DataFrame, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """(node, root) of those distinct fingerprints `fp` that have a link; without `blocks` their number follows that of the fingerprints."""
    return components(links(fps, max_bits, blocks or blocks_for(fps.count(), max_bits)))


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of `max_bits` bits or fewer.

    Null, empty and blank texts have the fingerprint 0 and link like any other. Rows that repeat a doc_id each get
    a row; a null doc_id is never the smallest unless the whole component has no other. Only distinct fingerprints are
    linked, so exact copies never form pairs. Without `blocks` their number follows that of the fingerprints.
    """
    own = fingerprints(docs, width).checkpoint()
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = fingerprint_roots(first.select("fp"), max_bits, blocks)
    linked = first.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    # a component may hold a third of all fingerprints: its members meet its smallest doc_id in SALTS tasks
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = linked.join(least, ["root", "salt"]).select("fp", "component_id")
    every = first.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return own.join(every, "fp").select("doc_id", "fp", "component_id")


def row_key(doc_id: str = "doc_id") -> Column:
    """A row's id, null as the smallest number. With text_key() it tells rows apart."""
    return F.coalesce(doc_id, F.lit(-(1 << 63))).alias("_row_id")


def text_key() -> Column:
    """Hash of a row's text, null as empty."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row_text")


def outlines(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, hash, fp, print, same, n, bands): a hash of the text, SimHash of its distinct words and that of
    near_duplicates; hash, size and band keys of its set of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in utf8(batch.column(1)):
                grams = shingles(text, width)
                found.append((fingerprint(b" ".join(sorted(set(text.lower().split()))), 1), fingerprint(text, 4), signed(xxhash.xxh64_intdigest(grams.tobytes())), len(grams), bands(grams)))
            *numbers, keys = zip(*found) if found else ((), (), (), (), ())
            arrays = [batch.column(0), batch.column(2), *[pa.array(x, pa.int64()) for x in numbers], pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "hash", "fp", "print", "same", "n", "bands"])

    return docs.select("doc_id", "text", text_key().alias("hash")).mapInArrow(run, "doc_id long, hash long, fp long, print long, same long, n long, bands array<long>")


def bands(grams: np.ndarray) -> np.ndarray:
    """A key for each of `BANDS` bands: hash of its number and of `BAND_ROWS` minima of the shingles' reseeded hashes; none without shingles.

    Two sets of similarity s share the key of a band at a rate of s ** BAND_ROWS, so that of the pairs at 0.8 all
    but about 7 in 100,000 share one, of those at 0.85 all but one in a million, wherever the sets differ.
    """
    if not len(grams):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    factor, mask = SEEDS[0] | np.uint64(1), SEEDS[1]
    for lo in range(0, len(grams), 1024):
        mixed = (grams[lo : lo + 1024, None] ^ mask) * factor
        least = np.minimum(least, ((mixed ^ mixed >> np.uint64(32)) * factor).min(axis=0))
    return np.array([signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.int64)


def marks(grams: np.ndarray) -> np.ndarray:
    """One bit for each remainder of a shingle's hash. A bit that only one of two sets has stands for a shingle that the other lacks."""
    bits = np.zeros(MARKS, np.uint8)
    bits[grams % np.uint64(MARKS)] = 1
    return np.packbits(bits).view(np.uint64)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased words' shingles; fewer words: one of them all; none: nothing."""
    words = text.lower().split()
    width = min(width, len(words))
    return distinct(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(len(words) - width + 1 if words else 0)], np.uint64))


def near_in_cells(batches: Iterator[pa.RecordBatch], max_bits: int, similarity: float, ample: int = 2, whole: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, fp, id, n), sorted by the first three: candidate links (a, b) among the rows of each cell part.

    Where a cell part has more than `ample` links a member, each member keeps the links to its best connected and to its
    nearest neighbour, and comes out itself as well, as (key, i, j, a) without b, for the pairs left aside to be looked
    at later. With `whole`, the rows of a cell part of up to so many pair whatever their bits; those of a larger one
    pair within `max_bits`, and all of them come out for later.
    """

    def candidates(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.append(0, np.flatnonzero(np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)) + 1)
        sizes = np.diff(np.append(starts, rows.shape[1]))
        left = np.repeat(starts + sizes, sizes) - np.arange(rows.shape[1])  # rows of the cell part from this one on
        fp, n = rows[3].view(np.uint64), rows[5]
        seen, a, b, bits = embed(fp), [], [], []
        bound = np.repeat(np.where(sizes <= (whole or 0), 64, max_bits), sizes)
        at = np.arange(rows.shape[1])
        for d in range(1, int(sizes.max())):
            at = at[left[at] > d]
            i = at[np.bitwise_count(seen[at] ^ seen[at + d]) <= bound[at]]
            apart = np.bitwise_count(fp[i] ^ fp[i + d])
            fits = (apart <= bound[i]) & (rows[4][i] != rows[4][i + d]) & (np.minimum(n[i], n[i + d]) >= similarity * np.maximum(n[i], n[i + d]))
            a.append(i[fits])
            b.append(i[fits] + d)
            bits.append(apart[fits])
        empty = [np.zeros(0, np.int64)]
        a, b, bits = np.concatenate(a or empty), np.concatenate(b or empty), np.concatenate(bits or empty)
        cell = np.repeat(np.arange(len(starts)), sizes)
        dense = np.bincount(cell[a], minlength=len(starts)) > ample * sizes
        if dense.any():
            degree = np.bincount(np.concatenate([a, b]), minlength=rows.shape[1])
            keep = ~dense[cell[a]]
            one, other, pair = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
            for order in (np.lexsort((rows[4][other], -degree[other], one)), np.lexsort((rows[4][other], np.tile(bits, 2), one))):
                keep[pair[order[np.append(True, one[order][1:] != one[order][:-1])]]] = True
            a, b = a[keep], b[keep]
        later = dense if whole is None else dense | (sizes > whole)
        x, y, member = rows[4][a], rows[4][b], np.flatnonzero(later[cell])
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.minimum(x, y), rows[4][member]])),
                pa.concat_arrays([pa.array(np.maximum(x, y)), pa.nulls(len(member), pa.int64())]),
                *[pa.concat_arrays([none, pa.array(rows[k][member])]) for k in range(3)],
            ],
            names=["a", "b", "key", "i", "j"],
        )

    def by_work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole cell parts, so few at a time that their pairs fit in memory."""
        starts = np.append(0, np.flatnonzero(np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)) + 1)
        turn = np.cumsum(np.diff(np.append(starts, rows.shape[1])) ** 2) // PAIRS_AT_ONCE
        yield from map(candidates, np.split(rows, starts[1:][turn[1:] != turn[:-1]], axis=1))

    rest, held = [], 0
    for batch in batches:
        rest.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        held += batch.num_rows
        if held >= BLOCK_ROWS:  # a cell part is smaller, so each block completes some
            rows = np.concatenate(rest, axis=1)
            own = int(np.all(rows[:3] == rows[:3, -1:], axis=0).sum())
            cut = rows.shape[1] - own
            rest, held = [rows[:, cut:]], own
            if cut:
                yield from by_work(rows[:, :cut])
    if held:
        yield from by_work(np.concatenate(rest, axis=1))


def join_parts(part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between parts that members of one cell part join: fewer than it has parts, whatever its pairs.

    A pair is compared unless its parts are joined already, its sizes do not allow the similarity or its marks leave too
    few shingles in common: a bound, so no pair that is alike goes.
    """
    label, out = part.copy(), []
    n = np.array([len(x) for x in sets])
    bits = np.stack([marks(x) for x in sets])
    for i in range(len(part) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])]
        both = bits[i] & bits[j]
        most = np.minimum(*[n[k] - np.bitwise_count(bits[k] ^ both).sum(axis=1, dtype=np.int64) for k in (i, j)])
        for k in j[most * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6].tolist():
            if label[k] == label[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if shared >= similarity * (n[i] + n[k] - shared):
                out.append((int(label[i]), int(label[k])))
                label[label == label[k]] = label[i]
    return out


def joins_in_cells(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, part, grams), sorted by the first three: links (a, b) between parts, by pairs of each cell part."""

    def links(part: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = join_parts(np.concatenate(part), sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

    now, part, sets = None, [], []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        parts, lists = batch.column(3).to_numpy(), batch.column(4)
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        starts = np.append(0, np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1) if batch.num_rows else []
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(keys[:, lo].tolist())
            if key != now:
                if part:
                    yield links(part, sets)
                now, part, sets = key, [], []
            part.append(parts[lo:hi])
            sets += [values[a:b].copy() for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])]
    if part:
        yield links(part, sets)


CANDIDATES = "a long, b long, key long, i long, j long"


def similar_candidates(classes: DataFrame, max_bits: int, similarity: float, split: int = 512, ample: int = 2, whole: int = 64, more: DataFrame | None = None) -> DataFrame:
    """Candidate links (a, b) between classes (id, fp, n, bands) that share the key of a band, or one of those of `more` (id, key),
    and whose sizes allow the similarity.

    Cell parts that are dense, or of over `whole` members, give only some of their links, the latter within
    `max_bits` bits of the fingerprints, and their members as (key, i, j, a) without b.
    """
    cells = classes.where("n > 0").select("id", "fp", "n", F.explode("bands").alias("key"))
    if more is not None:
        cells = cells.unionByName(classes.where("n > 0").select("id", "fp", "n").join(more, "id"))
    hot = cells.groupBy("key").count().where(F.col("count") > split).checkpoint()
    hot = F.broadcast(hot) if hot.count() <= FEW_KEYS else hot
    dealt = (
        cells.join(hot, "key", "left")
        .withColumn("parts", F.ceil(F.coalesce(F.col("count"), F.lit(1)) / split).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "id", "n")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    return dealt.mapInArrow(lambda batches: near_in_cells(batches, max_bits, similarity, ample, whole), CANDIDATES).distinct()


def thinned(found: DataFrame, ample: int = 16) -> DataFrame:
    """Links (a, b) but, between two nodes with over `ample` each, only those of the best connected neighbours."""
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("deg"))
    hub = both.join(degree.select(F.col("a").alias("b"), "deg"), "b").groupBy("a").agg(F.max(F.struct("deg", (-F.col("b")).alias("b"))).alias("hub"), F.count("*").alias("own"))
    hub = hub.select("a", "own", (-F.col("hub.b")).alias("hub"))
    linked = found.join(hub, "a").join(hub.select(F.col("a").alias("b"), F.col("own").alias("own_b"), F.col("hub").alias("hub_b")), "b")
    return linked.where((F.least("own", "own_b") <= ample) | (F.col("hub") == F.col("b")) | (F.col("hub_b") == F.col("a"))).select("a", "b")


def shingle_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(id, grams) of the needed classes (id). A class is the hash of its set; the set is made again from the text of
    the one row that stands for the class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in utf8(batch.column(0))]
            hashes = [signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "grams"])

    rows = classes.join(needed, "id", "left_semi").select(row_key("row_id"), F.col("row_text").alias("_row_text"))
    texts = docs.select("text", row_key(), text_key()).join(rows, ["_row_id", "_row_text"], "left_semi").select("text")
    return texts.mapInArrow(run, "id long, grams array<long>").dropDuplicates(["id"]).checkpoint()


def alike(docs: DataFrame, classes: DataFrame, candidates: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the candidate links (a, b) between classes whose whole sets of shingles are alike by `similarity`."""
    needed = candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct()
    sets = shingle_sets(docs, classes, needed, width)
    pairs = candidates.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def row_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 8) -> DataFrame:
    """(doc_id, hash, group): of each row the hash of its text and the group it is in, by any of the group's members' hash.

    Classes meet in the components of near_duplicates' fingerprints, by segment popcounts and grids, and in the cells of
    the bands, for those texts that are alike but far apart in fingerprints. Candidates are verified in two turns. The first takes a few links of each member of a large cell, which mostly
    joins it. The second goes back to the cells that still hold more than one part, with the sets of their members:
    every pair between two parts is compared where it is, and only the joins come out, fewer than members. So no link
    that could join two groups goes unverified, and what is sent grows with the rows, not with their pairs.
    """
    own = outlines(docs, width).checkpoint()
    least = F.min(F.struct("doc_id", "hash"))
    classes = own.groupBy("same").agg(least.alias("row"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    classes = classes.select(F.col("same").alias("id"), F.col("row.doc_id").alias("row_id"), F.col("row.hash").alias("row_text"), "fp", "n", "bands").checkpoint()
    prints = own.select("same", "print").distinct().checkpoint()
    roots = fingerprint_roots(prints.select(F.col("print").alias("fp")).distinct().checkpoint())
    met = prints.join(roots, F.col("print") == F.col("node"), "left").select(F.col("same").alias("id"), F.xxhash64(F.coalesce("root", "print"), F.lit(BANDS)).alias("key")).distinct()
    found = similar_candidates(classes.select("id", "fp", "n", "bands"), max_bits, similarity, more=met).checkpoint()
    let_go(docs.sparkSession)
    pairs = found.where("b is not null").select("a", "b")
    first = thinned(pairs).checkpoint()
    roots = components(alike(docs, classes, first, width, similarity))
    parts = classes.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("part")).checkpoint()

    part_a, part_b = [parts.select(F.col("id").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab"]
    apart = pairs.join(first, ["a", "b"], "left_anti").join(part_a, "a").join(part_b, "b").where("part_a <> part_b").checkpoint()
    let_go(docs.sparkSession)
    joins = alike(docs, classes, apart.select("a", "b"), width, similarity).join(apart, ["a", "b"]).select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))

    members = found.where("b is null").select("key", "i", "j", F.col("a").alias("id")).join(parts, "id")
    mixed = members.groupBy("key").agg((F.min("part") < F.max("part")).alias("mixed")).where("mixed").select("key")
    members = members.join(mixed, "key", "left_semi").checkpoint()
    let_go(docs.sparkSession)
    sets = shingle_sets(docs, classes, members.select("id").distinct(), width)
    dealt = members.join(sets, "id").select("key", "i", "j", "part", "grams").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    inside = dealt.mapInArrow(lambda batches: joins_in_cells(batches, similarity), "a long, b long")
    roots = components(joins.unionByName(inside))
    grouped = parts.join(roots, F.col("part") == F.col("node"), "left").select(F.col("id").alias("same"), F.coalesce("root", "part").alias("group"))
    return own.select("doc_id", "hash", "same").join(grouped, "same").select("doc_id", "hash", "group")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, max_bits: int = 8) -> DataFrame:
    """(doc_id, component_id), a row for each row: the smallest doc_id reachable over links of texts alike by `similarity` or more.

    Similarity is the Jaccard one of the sets of `width`-word shingles. Candidates are texts in one component of
    near_duplicates, and those that share the key of one of the bands, whatever their fingerprints; each is verified on the whole sets. Texts with equal sets are one class
    and never pair; null, empty and blank texts are one class. Groups are of texts, so two texts under one doc_id can be
    in two groups; a null doc_id counts only where its group has no other.
    """
    rows = row_groups(docs, width, similarity, max_bits)
    return rows.join(rows.groupBy("group").agg(F.min("doc_id").alias("component_id")), "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of alike texts: the smallest doc_id's (null last), then that of the text's smallest hash.

    Of rows that agree in doc_id and text one stays. Rows are told apart by both, so a text that is like no other
    stays whatever its doc_id: null, or another text's too. Null, empty and blank texts are one group. Columns stay as
    they are; an empty table gives an empty one.
    """
    rows = row_groups(docs, width, similarity)
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("row"))
    kept = first.select(row_key("row.doc_id"), F.col("row.hash").alias("_row_text"))
    return docs.select("*", row_key(), text_key()).join(kept, ["_row_id", "_row_text"], "left_semi").dropDuplicates(["_row_id", "_row_text"]).drop("_row_id", "_row_text")
