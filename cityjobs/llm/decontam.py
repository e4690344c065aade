"""Benchmark passages in documents, by the q-gram lemma.

Texts are compared as lower-cased words joined by single spaces. An item of m bytes inside a text with at most k
edits shares at least m + 1 - q (k + 1) of its q-grams with it, on diagonals (place in the text minus place in the
item) that differ by at most k. Diagonals are counted in bands of 2 (k + 1) that overlap by half, so the k + 1
diagonals of any such region lie in one band. Bands that reach the bound are verified by a banded alignment. With
q = 8 a q-gram is one 64-bit number.

The budget is a tenth of an item's length, less where an item is so short that the bound would not be positive.
Items shorter than q are found as whole words only.

A q-gram that an item holds more than FEW times is not paired with each of its places: every band that one of them
could lie in counts all of them, which never counts too few, and the alignment decides. Hits are counted HITS at a
time, so that a text and an item that repeat one passage over and over take bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, utf8

Q, RATE = 8, 0.1
PIECE = 1 << 20
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22
FEW, HITS = 4, 1 << 21


def canonical(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(data: bytes) -> np.ndarray:
    n = len(data) - Q + 1
    return np.ndarray((max(0, n),), "<u8", data if n > 0 else bytes(8), 0, (1,)).copy()


def slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


@dataclass
class Items:
    """A block of items, with the sorted q-grams of all of them."""

    ids: list[int]
    texts: list[bytes]

    def __post_init__(self) -> None:
        size = np.array([len(t) for t in self.texts], np.int64)
        edits = np.minimum((size * RATE).astype(np.int64), np.maximum(0, size // Q - 1))
        self.size, self.edits, self.least = size, edits, size + 1 - Q * (edits + 1)
        found = [grams(t) if len(t) >= Q else np.zeros(0, np.uint64) for t in self.texts]
        gram = np.concatenate([np.zeros(0, np.uint64), *found])
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in found)])
        order = np.argsort(gram, kind="stable")
        gram, item, self.place = gram[order], item[order], place[order]
        # an entry is one q-gram of one item, with its places from `at` on
        new = np.append(np.ones(min(1, len(gram)), bool), (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]))
        self.at = np.flatnonzero(new)
        self.gram, self.item, self.times = gram[self.at], item[self.at], np.diff(np.append(self.at, len(gram)))
        self.first, self.last = self.place[self.at], self.place[self.at + self.times - 1]
        self.rank = np.cumsum(self.times > FEW) - 1
        self.weight = self.times[self.times > FEW]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[slot(self.gram)] = True
        self.masks = [masks(t) for t in self.texts]
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < Q]


def masks(item: bytes) -> dict[int, int]:
    """Of each byte, the places where the item has it, as bits."""
    out: dict[int, int] = {}
    for i, byte in enumerate(item):
        out[byte] = out.get(byte, 0) | 1 << i
    return out


def fewest_edits(places: dict[int, int], m: int, region: bytes) -> tuple[int, int]:
    """The least edit distance of an item of m bytes and any part of the region, and where the first such part ends: a
    column a step, as bit vectors.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, byte in enumerate(region, 1):
        same = places.get(byte, 0)
        x = same | down
        d = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(d | up)), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, end = score, at
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(x | plus)), plus & x
    return best, end


def distance(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the item inside the region, by a banded alignment; None above k.

    Row i holds the places i - k .. i + len(region) - len(item) + k; a match may begin and end anywhere. Of equal
    matches the first to end counts.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if not k:
        return None
    text = np.frombuffer(region, np.uint8)
    width = len(region) - len(item) + 2 * k + 1
    if width < 1:
        return None
    big = 1 << 30
    column = np.arange(width) - k  # the places of row 0; row i adds i
    cost = np.where((column >= 0) & (column <= len(text)), 0, big)
    start = column.copy()
    step = np.arange(width)
    for i, byte in enumerate(item, 1):
        place = column + i
        inside = (place >= 1) & (place <= len(text))
        same = np.zeros(width, bool)
        same[inside] = text[place[inside] - 1] == byte
        down = np.append(cost[1:], big) + 1  # the item's byte is missing in the text
        across = cost + np.where(same, 0, 1)  # the cell above and to the left
        across[place < 1] = big
        best = np.minimum(down, across)
        origin = np.where(across <= down, start, np.append(start[1:], 0))
        best[(place < 0) | (place > len(text))] = big
        # a text byte that the item lacks: the least of what stands to the left
        lead = best - step
        run = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == run, step, 0))
        cost, start = run + step, origin[source]
        cost[(place < 0) | (place > len(text))] = big
    end = int(cost.argmin())
    if cost[end] > k:
        return None
    return int(cost[end]), int(start[end]), int(end - k + len(item))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, n numbers."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def likely_bands(data: bytes, items: Items) -> tuple[np.ndarray, int]:
    """Keys item * bands + band of the bands that reach their item's bound, and the number of bands.

    Band b holds the diagonals, the longest item's size added, from (b - 1) to (b + 1) times the item's step.
    """
    longest = int(items.size.max(initial=0))
    bands, units = len(data) + 2 * longest + 3, longest + 1 + len(items.weight)
    met = []
    for begin in range(0, max(1, len(data)), PIECE):
        gram = grams(data[begin : begin + PIECE + Q - 1])
        at = np.flatnonzero(items.filter[slot(gram)])
        lo, hi = np.searchsorted(items.gram, gram[at], "left"), np.searchsorted(items.gram, gram[at], "right")
        met.append(np.stack([at + begin, lo, hi - lo])[:, hi > lo])
    at, lo, n = np.concatenate(met, axis=1)
    turn = np.cumsum(n) // HITS
    parts, held = [np.zeros(0, np.int64)], 0
    for some in np.split(np.arange(len(at)), np.flatnonzero(turn[1:] != turn[:-1]) + 1):
        entry, place = spread(lo[some], n[some]), np.repeat(at[some], n[some]) + longest
        few = items.times[entry] <= FEW
        e, m = entry[few], items.times[entry[few]]
        own = items.place[spread(items.at[e], m)]
        item = np.repeat(items.item[e], m)
        code = (item * bands + (np.repeat(place[few], m) - own) // (items.edits[item] + 1)) * units + own
        e, p = entry[~few], place[~few]
        step = items.edits[items.item[e]] + 1
        first = (p - items.last[e]) // step
        many = (p - items.first[e]) // step + 2 - first
        other = spread(items.item[e] * bands + first, many) * units + np.repeat(longest + 1 + items.rank[e], many)
        parts.append(distinct(np.concatenate([code, code + units, other])))
        held += len(parts[-1])
        if held > 4 * HITS:
            parts, held = [distinct(np.concatenate(parts))], 0
    # the lemma counts the item's q-grams, each once however often the text repeats it
    code = distinct(np.concatenate(parts)) if len(parts) > 2 else parts[-1]
    unit = code % units
    weight = np.where(unit <= longest, 1, np.append(items.weight, 0)[np.maximum(unit - longest - 1, -1)])
    key = code // units  # in order, as the codes are
    first = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    count, key = np.add.reduceat(weight, first) if len(first) else weight, key[first]
    return key[count >= items.least[key // bands]], bands


def search(texts: list[bytes], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, edits, start, end): the best region for each text and item."""
    data = b"\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    key, bands = likely_bands(data, items)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, b in zip((key // bands).tolist(), (key % bands).tolist()):
        k, m = int(items.edits[i]), int(items.size[i])
        first = (b - 1) * (k + 1) - int(items.size.max())  # of the band's diagonals
        middle = first + k + m // 2
        t = int(min(max(np.searchsorted(starts, middle, "right") - 1, 0), len(texts) - 1))
        for text in {t, int(max(np.searchsorted(starts, first, "right") - 1, 0)), int(min(np.searchsorted(starts, first + 2 * k + m, "right") - 1, len(texts) - 1))}:
            begin, end = int(starts[text]), int(starts[text]) + len(texts[text])
            a, z = max(begin, first - k), min(end, first + 2 * (k + 1) + m + k)
            if z - a < m - k or best.get((text, i), (1,))[0] == 0:
                continue
            least, last = fewest_edits(items.masks[i], m, data[a:z])
            if least > k:
                continue
            # the alignment keeps to the diagonals that end there and to as many edits: a narrow band, however wide the budget
            a, z = max(a, a + last - m - least), a + last
            found = distance(items.texts[i], data[a:z], least)
            if found:
                found = (found[0], found[1] + a - begin, found[2] + a - begin)
                best[text, i] = min(best.get((text, i), found), found)
    for i in items.short:
        for text, t in enumerate(texts):
            where = (b" " + t + b" ").find(b" " + items.texts[i] + b" ")
            if where >= 0:
                best[text, i] = (0, where, where + len(items.texts[i]))
    return [(text, i, *found) for (text, i), found in sorted(best.items())]


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Distinct items in blocks of about BLOCK_BYTES, each sent to all tasks; one item is read at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id").toLocalIterator():
        text = canonical(row["text"].encode())
        if text:
            ids.append(row["item_id"])
            texts.append(text)
            size += len(text)
        if size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


COLUMNS = "doc_id long, item_id long, edits int, start int, end int"


def found_in(texts: list[bytes], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """What search() finds in all texts, about PIECE bytes of them at a time, by their number and the item's id."""
    some, first, size = [], 0, 0
    for n, text in enumerate(texts):
        some.append(canonical(text))
        size += len(text)
        if size >= PIECE or n + 1 == len(texts):
            yield from ((first + t, items.ids[i], *rest) for t, i, *rest in search(some, items))
            some, first, size = [], n + 1, 0


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the best region of each document and item within the edit budget.

    start and end are byte places in the document's canonical text. Benchmark items are a query set, taken in blocks
    of a fixed size; every block meets every document. Null and empty texts and items match nothing; an empty table
    or benchmark gives no rows. Rows that repeat a doc_id give rows each, and so do items that repeat a text.
    """
    spark = docs.sparkSession
    found = None
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[n], *rest) for n, *rest in found_in(utf8(batch.column(1)), sent.value)]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "item_id", "edits", "start", "end"])

        some = docs.select("doc_id", "text").mapInArrow(run, COLUMNS)
        found = some if found is None else found.unionByName(some)
    return found if found is not None else spark.createDataFrame([], COLUMNS)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose own text holds no benchmark passage; columns and repeated rows as they are, no shuffle.

    Each row is judged by its text alone, whatever its doc_id: one with a null id goes if its text is contaminated, and
    a clean one stays where another row of its id goes. Null and empty texts stay; an empty benchmark keeps all rows.
    """
    kept = docs
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[n for n, *_ in found_in(utf8(batch.column("text")), sent.value)]] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
