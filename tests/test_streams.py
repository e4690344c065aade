"""Stateful streams: out-of-order readings, state that goes, stretches of requests."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from cityjobs.streaming import jobs

START = datetime.datetime(2025, 1, 1)
SECOND = datetime.timedelta(seconds=1)


def test_latest_reading_and_its_state(spark, tmp_path):
    place, out = tmp_path / "in", str(tmp_path / "out")
    at = lambda day, hour=0: START + datetime.timedelta(days=day, hours=hour)
    write = lambda rows: spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(place))
    batches = []

    def keep(rows, n):
        batches.append(sorted((r["k"], r["ts"].day, r["v"]) for r in rows.collect()))

    def job():
        batches.clear()
        stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(place))
        query = jobs.stream_latest(stream, "k", "ts", "1 day", datetime.timedelta(days=3)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return [r for b in batches for r in b], state[-1]

    write([("a", at(3), 1.0), ("a", at(2), 9.0), ("b", at(3), 2.0), ("a", None, 7.0)])
    assert job()[0] == [("a", 4, 1.0), ("b", 4, 2.0)]
    write([("a", at(2, 20), 5.0), ("b", at(4), None), ("c", at(4), 3.0), ("b", at(3, 1), 4.0)])  # a's is out of order
    assert job()[0] == [("b", 5, None), ("c", 5, 3.0)]
    write([("d", at(12), 6.0)])
    found, _ = job()
    assert found == [("d", 13, 6.0)]
    write([("d", at(12, 1), 7.0), ("a", at(3), 8.0)])  # a's is later than the watermark
    found, rows = job()
    assert found == [("d", 13, 7.0)]
    assert rows <= 2 * 2  # d's reading and timer alone: a, b and c are gone
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_requests_in_stretches(spark):
    """A hot key in bursts, and keys at random: decided as one by one; a stretch is never longer than its burst."""
    rng = np.random.default_rng(1)
    rows = [("hot", burst * 100 + float(t)) for burst in range(50) for t in np.sort(rng.uniform(0, 60, size=40))]
    rows += [(f"k{i % 9}", float(t)) for i, t in enumerate(rng.uniform(0, 2_000, size=900))] + [("edge", t) for t in (0.0, 10.0, 20.000001, 30.000001, 40.0)] + [(None, 1.0), ("n", None)]
    df = spark.createDataFrame([(k, None if t is None else START + t * SECOND) for k, t in rows], "k string, ts timestamp")
    log, want = {}, []
    for k, t in sorted((k, START + t * SECOND) for k, t in rows if k is not None and t is not None):
        log[k] = [x for x in log.get(k, []) if (t - x).total_seconds() <= 10]
        want.append((k, t, len(log[k]) < 2))
        if want[-1][2]:
            log[k].append(t)
    assert sorted(map(tuple, jobs.rate_limit(df, "k", "ts", 10, 2).collect())) == want
    found = jobs.stretches(df.select(F.col("k").alias("key"), "ts").where("k is not null and ts is not null"), 10)
    sizes = {r["stretch"]: r["count"] for r in found.where("key = 'hot'").groupBy("stretch").count().collect()}
    assert len(sizes) >= 50 and max(sizes.values()) <= 40
    assert len({r["stretch"] for r in found.where("key = 'edge'").collect()}) == 2  # only a pause longer than the window
