"""Token ids in Parquet list columns, in ascending doc_id order.

Ids are dictionary-encoded (a vocabulary's ids fit one dictionary page), numbers that keep rising are delta-encoded,
row groups and pages are small enough for selective reads, and the writer's page indexes let a reader skip pages by
doc_id. Reading metadata alone never touches the ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import utf8

BLANK, LATIN, SIGN = r" \t\n\r\x0b\x0c", "A-Za-zÀ-ÖØ-öø-ÿ", r".,!?;:$%&#*|"
#: A word of Latin letters alone or before signs, signs before white space, or any other run without white space.
CHUNK = re.compile(f"[{LATIN}]+(?=[{BLANK}{SIGN}]|$)|[{SIGN}]+(?=[{BLANK}]|$)|[^{BLANK}]+")
TABLE_ROWS, TABLE_CHARS = 320_000, 64
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class WordTable:
    """Ids of distinct chunks. This tokenizer folds case, drops white space and never joins a letter with such a sign,
    so chunks are encoded on their own. A chunk of letters is one pre-token, and only its last id has the mark for a
    word's end: many are encoded as one text and cut at those ids.

    A table belongs to a worker process and serves all its tasks. When TABLE_ROWS chunks are in it they become the
    old ones: those that occur again are taken over, the others go when the table is full the next time.
    """

    def __init__(self, path: str, end_id: int) -> None:
        self.tokenizer, self.end = load(path), np.array([end_id], "<u4").tobytes()
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def learn(self, letters: list[str], others: list[str]) -> None:
        encode = self.tokenizer.encode_batch_fast
        for lo in range(0, len(letters), 5_000):
            some = letters[lo : lo + 5_000]
            ids = np.array(encode([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at, data = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()], ids.tobytes()
            if len(at) != len(some) + 1:
                raise ValueError("a word of letters is not one pre-token of this tokenizer")
            self.ids.update((w, data[a:b]) for w, a, b in zip(some, at, at[1:]))
        for lo in range(0, len(others), 5_000):
            some = others[lo : lo + 5_000]
            self.ids.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(some, encode(some, add_special_tokens=False)))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # A-Z is folded here already, for fewer distinct chunks; not where that could spell a special token
        cut = [CHUNK.findall((t if b"<|" in t else t.lower()).decode()) for t in texts]
        if len(self.ids) > TABLE_ROWS:
            self.ids, self.old = {}, self.ids
        new = set(chain.from_iterable(cut)).difference(self.ids)
        again = new & self.old.keys()
        self.ids.update((w, self.old[w]) for w in again)
        new -= again
        letters = {w for w in new if len(w) <= TABLE_CHARS and LETTERS.fullmatch(w)}
        self.learn(list(letters), list(new - letters))
        out = [b"".join([*map(self.ids.__getitem__, words), self.end]) for words in cut]
        for word in new:
            if len(word) > TABLE_CHARS:
                del self.ids[word]
        return out


LETTERS = re.compile(f"[{LATIN}]+")


@lru_cache(maxsize=2)
def word_table(path: str, end_id: int) -> WordTable:
    """The worker process's table."""
    return WordTable(path, end_id)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Files of (shard, doc_id, n_tokens, shard_start, ids), each sorted by doc_id, shards in doc_id order.

    Null texts count as empty: the end id alone. Rows that repeat a doc_id, or have none, stay, ordered by a hash of
    their text; ranges are cut by both, so that however many such rows there are they are dealt to many tasks and files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start, shard = word_table(tokenizer_path, end_id), 0, TaskContext.get().partitionId()
        for batch in batches:
            found = table.encode(utf8(batch.column(1)))
            sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            names = ["shard", "doc_id", "n_tokens", "shard_start", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), shard, np.int32)), batch.column(0), pa.array(sizes), pa.array(start + ends - sizes), ids], names=names)
            start += int(ends[-1]) if len(ends) else 0

    (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .mapInArrow(run, "shard int, doc_id long, n_tokens long, shard_start long, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#shard_start", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before.

    A row for each row written: null ids come first, a null or empty text has the end id alone, rows that repeat a doc_id
    follow each other by a hash of their text. An empty store gives no rows.
    """
    rows = spark.read.parquet(path)
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row for each file, and a running sum over those
    before = sums.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives, counted from the ids themselves, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])]
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
