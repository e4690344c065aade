"""The bucketed chunk store: what an upsert rewrites, and what a batch that comes again does."""

import datetime
import os

import pytest

from cityjobs.sources.store import ChunkStore, bucket_of
from cityjobs.streaming import jobs


def chunks_of(spark, docs, text):
    return spark.createDataFrame([(f"{d}_{k}", d, text) for d in docs for k in range(2)], "chunk_id string, doc_id string, display_text string")


def rows_of(store):
    return sorted((r["chunk_id"], r["display_text"]) for r in store.read().collect())


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "s")
    store = ChunkStore(spark, path, 8)
    with pytest.raises(ValueError):
        store.read()
    docs = [f"d{k}" for k in range(60)]
    assert len(store.upsert(chunks_of(spark, docs, "old"), 0)) == 8
    first = files_of(path)
    touched = store.upsert(chunks_of(spark, ["d3"], "new"), 1, spark.createDataFrame([("d7",), ("none",)], "doc_id string"))
    own = {r[0] for r in spark.createDataFrame([("d3",), ("d7",), ("none",)], "doc_id string").select(bucket_of("doc_id", 8)).collect()}
    assert set(touched) == own and len(own) <= 3
    second = files_of(path)
    assert all(second[f] == t for f, t in first.items())  # nothing that was there is written anew
    assert {f.split("bucket=")[1].split("/")[0] for f in second.keys() - first.keys()} == set(map(str, own & {r[0] for r in chunks_of(spark, [d for d in docs if d != "d7"], "").select(bucket_of("doc_id", 8)).distinct().collect()}))
    want = sorted([(f"{d}_{k}", "new" if d == "d3" else "old") for d in docs if d != "d7" for k in range(2)])
    assert rows_of(store) == want
    assert store.upsert(chunks_of(spark, ["d9"], "again"), 1) == [] and rows_of(store) == want and files_of(path) == second
    assert store.upsert(chunks_of(spark, [], ""), 2) == []


def test_a_batch_that_failed_before_its_commit_is_written_again(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"), 4)
    store.upsert(chunks_of(spark, ["a", "b"], "old"), 0)
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.upsert(chunks_of(spark, ["a"], "half"), 1)
    assert {t for _, t in rows_of(store)} == {"old"}  # readers see the last commit
    store.upsert(chunks_of(spark, ["a"], "whole"), 1)
    assert rows_of(store) == [("a_0", "whole"), ("a_1", "whole"), ("b_0", "old"), ("b_1", "old")]
    store.upsert(chunks_of(spark, [], ""), 2, spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    with pytest.raises(ValueError):
        store.read()
    store.upsert(chunks_of(spark, ["a"], "back"), 3)
    assert {t for _, t in rows_of(store)} == {"back"}


def test_stream_of_documents_into_the_store(spark, tmp_path):
    """Two runs of a stream, the second after its batch was committed but not logged: it changes nothing."""
    place, log = tmp_path / "in", str(tmp_path / "log")
    day = lambda d: datetime.datetime(2025, 1, d)
    schema = "source_url string, source_name string, title string, language string, doc_type string, text string, sections array<struct<heading:string,text:string,level:int>>, created_at date, updated_at timestamp"
    write = lambda rows: spark.createDataFrame([(u, "s", "t", "de", "reference", text, None, day(1).date(), day(d)) for u, text, d in rows], schema).coalesce(1).write.mode("append").parquet(str(place))
    store = ChunkStore(spark, str(tmp_path / "s"), 4)
    job = lambda log: jobs.stream_upsert(spark.readStream.schema(schema).parquet(str(place)), store, log).trigger(availableNow=True).start().awaitTermination()
    write([("a", "one", 1), ("b", "two", 1), ("a", "newer", 2)])
    job(log)
    texts = lambda: sorted(r["display_text"] for r in store.read().collect())
    assert texts() == ["newer", "two"]
    job(str(tmp_path / "other log"))  # the same batch numbers again
    assert texts() == ["newer", "two"] and store.manifest().select("batch").distinct().count() == 1
    write([("b", "latest", 3)])
    job(log)
    assert texts() == ["latest", "newer"]
