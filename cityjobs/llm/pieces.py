"""SentencePiece encoding by a table of distinct chunks.

The model's pieces have white-space markers at their front only, so no merge crosses from one marked word into the
next: a text is cut before every run of markers, each distinct chunk is segmented once by the library and its ids are
joined back by position. A model with other pieces is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import utf8

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
TABLE_ROWS, TABLE_CHARS = 300_000, 64


@lru_cache(maxsize=2)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing or len(model.encode(" a  b")) != len(model.encode(" a")) + len(model.encode(" b")) or model.encode("ﬁ") == model.encode("fi"):
        raise ValueError("this model's pieces cross white-space markers, or it rewrites texts")
    return model


class ChunkTable:
    """Ids of distinct chunks, as little-endian unsigned 32-bit integers. Starts anew when it is full."""

    def __init__(self, path: str) -> None:
        self.model = load(path)
        self.ids = {MARK: np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()}
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids) > TABLE_ROWS:
            self.ids = {MARK: self.ids[MARK]}
        new = list({c for chunks in cut for c in chunks if c not in self.ids})
        for chunk, ids in zip(new, self.model.encode([c[1:] for c in new], num_threads=1)):
            self.ids[chunk] = np.array(ids, "<u4").tobytes()
        out = [b"".join([self.begin, *map(self.ids.__getitem__, chunks), self.end]) for chunks in cut]
        for chunk in new:
            if len(chunk) > TABLE_CHARS:
                del self.ids[chunk]
        return out


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) with begin and end ids, a row for each row.

    Null texts count as empty: begin and end alone. Repeated rows get equal rows, an empty table none; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            found = table.encode([t.decode() for t in utf8(batch.column(1))])
            sizes = np.cumsum([0, *(len(x) // 4 for x in found)])
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, by the same table, in one pass.

    A row for each row, null ids too. Null texts count as empty: two ids, and the digest of ''. Repeated rows get equal
    rows, an empty table none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            found = table.encode([t.decode() for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found],
                    "decoded_sha256": [hashlib.sha256(table.model.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in found],
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
