"""Language-model scores by prediction by partial matching over byte contexts.

A text is its lower-cased words joined by single spaces, then one end symbol. Words hold no white space, so the
newline byte stands for the end and four control bytes never occur: 252 symbols. A context is the ORDER bytes before
a symbol; NUL bytes stand before the text. A code holds ORDER + 1 bytes, oldest in the low bits and the symbol on top, so
the code for a shorter context is a right shift.

Escape estimation is method D: with t symbols of d kinds left after exclusion, a symbol seen n times has
probability (2n - 1) / 2t and the escape d / 2t. Symbols seen in a longer context are excluded from shorter ones.
What exclusion leaves of a shorter context depends on the longer context alone, so every code has one fixed cost
under the trained trie. The last resort is uniform over the symbols never seen.

The plan: (1) documents are dealt into batches by hash; each batch lists the distinct codes and words that it holds,
with the counts of its training texts, in one packed row for every shard. A shard of codes is a range of contexts,
ordered from their last byte to their first, so that what shares a shorter context stands together; the limits are
quantiles of the codes of a sample, and only the sizes of shards depend on them. A shorter context that a limit cuts
in two is counted on both sides: each batch adds the counts of those contexts (three for a limit) to the rows of
both shards. So no context is too frequent to be cut. Words are sharded by their key. (2) a shuffle brings each shard
together, which adds up the counts and resolves its part of the trie, with the dense table of orders 0 and 1 (65,536
numbers) sent to all; (3) the answers go back to the batches, where each document adds up its own. Neither model
passes through the driver or has to fit into a task; a shard holds as much as a few batches, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, remainder, scratch, share, utf8

ORDER, END, SYMBOLS = 5, 10, 252
BATCH_BYTES, LEAST_BATCHES, LEAST_SHARDS = 16 << 20, 16, 32
PIECE = 1 << 20
PAD = bytes(ORDER)
MULTIPLIER = 0x9E3779B97F4A7C15
BYTE_KEYS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def segments(text: bytes) -> list[bytes]:
    """A text in one stretch, or in several that end at a space: four bytes before it, the text, and what ends it."""
    body = b" ".join(text.lower().split())
    if len(body) <= PIECE:
        return [PAD + body + b"\n"]
    body, out, lo = PAD + body + b"\n", [], ORDER
    while lo < len(body):
        cut = body.rfind(b" ", lo, lo + PIECE)
        cut = cut if cut >= 0 else body.find(b" ", lo + PIECE)
        hi = cut + 1 if cut >= 0 and len(body) - lo > PIECE else len(body)
        out.append(body[lo - ORDER : hi])
        lo = hi
    return out


def pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Segments of about PIECE bytes together, and the number of the text that each is from."""
    some, of, size = [], [], 0
    for i, text in enumerate(texts):
        for segment in segments(text):
            some.append(segment)
            of.append(i)
            size += len(segment)
            if size >= PIECE:
                yield some, of
                some, of, size = [], [], 0
    if some:
        yield some, of


def codes(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of each symbol, and where each segment's codes begin."""
    data = bytes(7) + b"".join(some)
    n = len(data) - 7
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(n, bool)
    keep[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    window = np.ndarray((n,), "<u8", data, 0, (1,))[keep]
    return (window >> np.uint64(8 * (7 - ORDER))).astype(np.int64), np.cumsum(sizes - ORDER) - (sizes - ORDER)


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            factors = np.full(2 * n, MULTIPLIER, np.uint64)
            factors[0] = 1
            cls.up = np.cumprod(factors)
            factors[1:] = np.uint64(pow(MULTIPLIER, -1, 1 << 64))
            cls.down = np.cumprod(factors)
        return cls.up, cls.down


def words(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word, and how many words each segment has.

    The key is a polynomial over random byte values modulo 2 ** 64, mixed; of 10**8 words, two share one with a
    chance of about 3 in 10,000.
    """
    data = np.frombuffer(b"".join(some), np.uint8)
    up, down = Powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=total[1:])
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    first = np.cumsum(sizes) - sizes
    body = np.ones(len(data), bool)
    body[(first[:, None] + np.arange(ORDER)).ravel()] = False
    ends = np.flatnonzero(((data == 32) | (data == END)) & body)
    segment = np.searchsorted(first, ends, "right") - 1
    starts = np.append(0, ends[:-1] + 1)
    starts = np.maximum(starts, first[segment] + ORDER)
    real = ends > starts
    starts, ends, segment = starts[real], ends[real], segment[real]
    key = (total[ends] - total[starts]) * down[starts]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(29))).view(np.int64), np.bincount(segment, minlength=len(some))


class Tally:
    """Distinct keys with counts, merged as they grow."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, weight: np.ndarray) -> None:
        inverse, distinct = pd.factorize(keys)
        self.parts.append((distinct, np.bincount(inverse, weight, len(distinct))))
        if len(self.parts) >= 16:
            self.parts = [self.done()]

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        inverse, distinct = pd.factorize(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in self.parts)]))
        return distinct, np.bincount(inverse, np.concatenate([np.zeros(0), *(n for _, n in self.parts)]), len(distinct))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for two shuffles of them."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([press.compress(t) for t in utf8(batch.column(3))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["b", "doc_id", "held_out", "z"])


def unpack(column: pa.ChunkedArray) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(z) for z in column.to_pylist()]


def pressed(values: np.ndarray, rising: bool = False) -> bytes:
    """An array in byte planes, compressed; rising numbers as differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values) if rising else values


CONTEXT = (1 << 8 * ORDER) - 1


def shard_of(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range that a code's context is in; bounds are the first contexts of all shards but the first."""
    return np.searchsorted(bounds, code & CONTEXT, "right")


def edges(code: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By shard, of those that any concern: the codes of orders 2 to 4, their order on top, whose contexts the shard's
    limits cut, with counts.
    """
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(2, ORDER):
        u, cut = code >> (8 * (ORDER - k)), bounds >> (8 * (ORDER - k))
        mask = (1 << (8 * k)) - 1
        inside = np.isin(u & mask, cut)
        own, inverse = np.unique(u[inside], return_inverse=True)
        count = np.bincount(inverse, n[inside], len(own)).astype(np.int64)
        order = np.argsort(own & mask, kind="stable")
        own, count = own[order], count[order]
        context, start = np.unique(own & mask, return_index=True)
        # a context that several limits in a row cut concerns the shards from before the first to behind the last
        first, last = np.searchsorted(cut, context, "left"), np.searchsorted(cut, context, "right")
        for lo, hi, a, z in zip(start.tolist(), [*start[1:].tolist(), len(own)], first.tolist(), last.tolist()):
            for shard in range(a, z + 1):
                parts.setdefault(shard, []).append((own[lo:hi] | k << 56, count[lo:hi]))
    return {shard: tuple(np.concatenate(x) for x in zip(*some)) for shard, some in parts.items()}


def word_shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (key & 65535) * shards >> 16


ASKED = "b int, shard int, code binary, code_n binary, word binary, word_n binary, edge binary, edge_n binary, low_code array<int>, low_n array<long>"


def ask(batch: pa.Table, bounds: np.ndarray) -> pa.Table:
    """A row for each shard that the batch has codes, words or cut contexts for, and one of shard -1 with its counts of
    order 1. So there are as many rows as batches times shards, but never more than the batches' distinct codes and words.
    """
    texts, held = unpack(batch.column("z")), np.array(batch.column("held_out").to_pylist(), bool)
    found = (Tally(), Tally())
    for some, of in pieces(texts):
        trained = (~held[of]).astype(float)
        keys, starts = codes(some)
        found[0].add(keys, np.repeat(trained, np.diff(np.append(starts, len(keys)))))
        keys, sizes = words(some)
        found[1].add(keys, np.repeat(trained, sizes))
    b, rows = batch.column("b")[0].as_py(), []
    (code, n), (word, m) = found[0].done(), found[1].done()
    low, inverse = np.unique(code >> (8 * (ORDER - 1)), return_inverse=True)
    rows.append((b, -1, *[None] * 6, low.tolist(), np.bincount(inverse, n, len(low)).astype(np.int64).tolist()))
    shards = len(bounds) + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = by_shard(code, n, shard_of(code, bounds)), by_shard(word, m, word_shard_of(word, shards)), edges(code, n, bounds)
    for shard in sorted(set().union(*cut)):
        (code, n), (word, m), (edge, k) = (x.get(shard, none) for x in cut)
        rows.append((b, shard, pressed(code, True), pressed(n), pressed(word, True), pressed(m), pressed(edge), pressed(k), None, None))
    names, kinds = [x.split()[0] for x in ASKED.split(", ")], [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def by_shard(keys: np.ndarray, n: np.ndarray, shard: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys with their counts by shard, of the shards that have any."""
    order = np.lexsort((keys, shard))
    met, at = np.unique(shard[order], return_index=True)
    keys, n = keys[order], n[order].astype(np.int64)
    return {int(k): (keys[x:y], n[x:y]) for k, x, y in zip(met, at, [*at[1:], len(keys)])}


def resolve(code: np.ndarray, n: np.ndarray, one: np.ndarray, edge: np.ndarray = np.zeros(0, np.int64), edge_n: np.ndarray = np.zeros(0, np.int64)) -> np.ndarray:
    """log10 probability of each distinct code, n its training count (0: only asked for).

    For every context of order 2 or more, either all its codes must be present or `edge` hold them all, with their
    order on top and edge_n as their counts. one[byte, symbol] are the counts of order 1.
    """
    whole = {k: (edge[edge >> 56 == k] & ((1 << 56) - 1), edge_n[edge >> 56 == k]) for k in range(2, ORDER)}
    zero = one.sum(0)
    start = escaped = None
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(ORDER + 1):
            cut = [x >> (8 * (j - k)) for j, (x, _) in whole.items() if j >= k]
            u, inverse = np.unique(np.concatenate([code >> (8 * (ORDER - k)), *cut]), return_inverse=True)
            inverse = inverse[: len(code)]
            symbol, context = u >> (8 * k), u & ((1 << (8 * k)) - 1)
            if k >= 2:
                counts = np.bincount(inverse, n, len(u))
                if k in whole:
                    counts[np.searchsorted(u, whole[k][0])] = whole[k][1]
                nodes, node = np.unique(context, return_inverse=True)
                total, kinds = np.bincount(node, counts, len(nodes)), np.bincount(node, counts > 0, len(nodes))
            else:
                grid = one if k else zero[None, :]
                counts, node = grid[context, symbol].astype(float), context
                total, kinds = grid.sum(1).astype(float), (grid > 0).sum(1).astype(float)
            seen = np.log10((2 * counts - 1) / (2 * total[node]))
            leave = np.log10(kinds[node] / (2 * total[node]))
            if not k:
                after = np.full(len(u), -np.log10(max(1.0, SYMBOLS - kinds[0])))
                start = np.where(total[node] == 0, -np.log10(SYMBOLS), np.where(counts > 0, seen, leave + after))
            else:
                below = np.searchsorted(last[0], u >> 8)
                if k == 1:
                    used = np.where(one > 0, zero[None, :], 0).sum(1).astype(float)
                else:
                    used = np.bincount(node, np.where(counts > 0, last[1][below], 0.0), len(total))
                parent = last[2][below]
                left, kinds_left = last[3][parent] - used[node], last[4][parent] - kinds[node]
                found = last[1][below]
                after = np.where(found > 0, np.log10((2 * found - 1) / (2 * left)), np.where(kinds_left > 0, np.log10(kinds_left / (2 * left)), 0.0) + escaped[below])
                start = np.where(total[node] == 0, start[below], np.where(counts > 0, seen, leave + after))
            escaped, last = after, (u, counts, node, total, kinds)
        return start[inverse]


ANSWERS = "b int, code binary, cost binary, word binary, word_n binary, new_words long"


def answer(shard: pa.Table, one: np.ndarray) -> pa.Table:
    """One shard's answers to every batch; its distinct trained words are counted once, in the first row."""
    b = shard.column("b").to_pylist()
    known = []
    for name in ("code", "word"):
        keys = [expanded(x, "<i8", True) for x in shard.column(name).to_pylist()]
        n = np.concatenate([expanded(x, "<i8") for x in shard.column(f"{name}_n").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        known.append((keys, distinct, inverse, np.bincount(inverse, n, len(distinct)).astype(np.int64)))
    (codes_, code, at_code, code_n), (words_, _, at_word, word_n) = known
    edge, inverse = np.unique(np.concatenate([expanded(x, "<i8") for x in shard.column("edge").to_pylist()]), return_inverse=True)
    edge_n = np.bincount(inverse, np.concatenate([expanded(x, "<i8") for x in shard.column("edge_n").to_pylist()]), len(edge)).astype(np.int64)
    cost = resolve(code, code_n, one, edge, edge_n)[at_code].astype("<f4")
    count = word_n[at_word]
    cost, count = np.split(cost, np.cumsum([len(x) for x in codes_])[:-1]), np.split(count, np.cumsum([len(x) for x in words_])[:-1])
    rows = [(b[i], pressed(codes_[i], True), pressed(cost[i]), pressed(words_[i], True), pressed(count[i]), 0 if i else int((word_n > 0).sum())) for i in range(len(b))]
    names, kinds = [x.split()[0] for x in ANSWERS.split(", ")], [pa.int32(), *[pa.binary()] * 4, pa.int64()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def add_up(docs: pa.Table, answers: pa.Table, ends: int) -> pa.Table:
    """Scores of one batch's documents from the answers to what it asked; new_words counts those it answers for."""
    new = sum(answers.column("new_words").to_pylist())
    tables = []
    for key, value, kind in (("code", "cost", "<f4"), ("word", "word_n", "<i8")):
        keys = np.concatenate([expanded(x, "<i8", True) for x in answers.column(key).to_pylist()])
        values = np.concatenate([expanded(x, kind) for x in answers.column(value).to_pylist()]).astype(float)
        order = np.argsort(keys)
        tables.append((keys[order], values[order]))
    n = docs.num_rows
    score, log_sum, known, tokens = np.zeros(n), np.full(n, np.log10(ends + 0.5)), np.full(n, int(ends > 0)), np.ones(n, np.int64)
    for some, of in pieces(unpack(docs.column("z"))):
        keys, starts = codes(some)
        inverse, distinct = pd.factorize(keys)
        cost = tables[0][1][np.searchsorted(tables[0][0], distinct)]
        np.add.at(score, of, np.add.reduceat(cost[inverse], starts))
        keys, sizes = words(some)
        inverse, distinct = pd.factorize(keys)
        count = tables[1][1][np.searchsorted(tables[1][0], distinct)]
        owner = np.repeat(of, sizes)
        log_sum += np.bincount(owner, np.log10(count + 0.5)[inverse], n)
        known += np.bincount(owner, (count > 0)[inverse], n).astype(np.int64)
        tokens += np.bincount(owner, minlength=n)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(tokens),
            "n_known": pa.array(known),
            "log_sum": pa.array(log_sum),
            "score": pa.array(score),
            "new_words": pa.array(np.append(new, np.zeros(n - 1, np.int64))),
            "trained": pa.array(np.where(docs.column("held_out").to_pylist(), 0, tokens)),
        }
    )


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double, new_words long, trained long"


def limits(rows: DataFrame, size: int, shards: int) -> np.ndarray:
    """First contexts of all shards but the first: quantiles of the distinct codes of about one batch of texts, one
    code in sixteen of which come to the driver. No result depends on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _ in pieces(utf8(batch.column(0))):
                code = distinct(codes(some)[0])
                mixed = (code.view(np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(60)
                yield pa.RecordBatch.from_arrays([pa.array(code[mixed == 0])], names=["code"])

    sample = rows.where(share(["doc_id", "text"], 29) < min(1.0, BATCH_BYTES / max(1, size))).select("text")
    found = np.sort(sample.mapInArrow(run, "code long").distinct().toArrow().column("code").to_numpy() & CONTEXT)
    return np.unique(found[np.arange(1, shards) * len(found) // shards]) if len(found) else np.zeros(0, np.int64)


def score_documents(docs: DataFrame, fold: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    A row for each row. Null texts count as empty: one end token, one end symbol. With no training text every symbol costs log10(252).
    Equal rows get equal rows; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (remainder("doc_id", fold) == held).alias("held_out"))
    facts = rows.agg(F.count_if(~F.col("held_out")).alias("ends"), F.sum(F.octet_length("text")).alias("size")).first()
    ends, size = facts["ends"], facts["size"] or 0
    batches = max(LEAST_BATCHES, -(-size // BATCH_BYTES))
    shards = max(LEAST_SHARDS, batches // 8)
    b = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("b")
    dealt = rows.select(b, "doc_id", "held_out", "text").mapInArrow(pack, "b int, doc_id long, held_out boolean, z binary").repartitionById(batches, "b")
    bounds = limits(rows, size, shards)

    asked_at, scored_at = scratch(spark, "asked"), scratch(spark, "scored")
    dealt.groupBy("b").applyInArrow(lambda t: ask(t, bounds), ASKED).write.parquet(asked_at)
    asked = spark.read.parquet(asked_at)
    low = asked.where("shard = -1").select(F.explode(F.arrays_zip("low_code", "low_n")).alias("x")).groupBy("x.low_code").agg(F.sum("x.low_n").alias("n")).toArrow()  # 65,536 rows at most
    one = np.zeros((256, 256), np.int64)
    at = low.column("low_code").to_numpy()
    one[at & 255, at >> 8] = low.column("n").to_numpy()

    replies = asked.where("shard >= 0").drop("low_code", "low_n").repartitionById(shards, "shard").groupBy("shard").applyInArrow(lambda t: answer(t, one), ANSWERS)
    dealt.groupBy("b").cogroup(replies.repartitionById(batches, "b").groupBy("b")).applyInArrow(lambda left, right: add_up(left, right, ends), SCORED).write.parquet(scored_at)
    scored = spark.read.parquet(scored_at)
    totals = scored.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("new_words"), F.lit(0))).first()
    train_tokens, kinds = totals[0], totals[1] + (ends > 0)
    base = F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(max(0.5, train_tokens + 0.5 * (kinds + 1)))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
