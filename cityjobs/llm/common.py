"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """A checkpoint folder, and Arrow batches small enough for very long texts."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of this machine in local mode, as in tests; an
    error on a cluster, whose executors share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle files and checkpoints of jobs that nothing
    refers to any more: between the turns of a long job, as a heap with room is collected rarely.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key's text modulo n: the split of rows into folds. A null key is the text ''."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def share(key: str | list[str], seed: int) -> Column:
    """A number from 0 to 1 that depends on the key columns alone."""
    keys = [key] if isinstance(key, str) else key
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order, by sorting: several times faster than numpy's own way by hashes."""
    x = np.sort(x)
    return x[np.append(np.ones(min(1, len(x)), bool), x[1:] != x[:-1])]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, bound: int, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, y and `more` columns of docs) of about `bound` labelled documents outside the held-out fold.

    A document labelled more than once takes the rounded mean; of rows that repeat a doc_id the smallest text counts,
    so that the sample is bounded. The sampled labels are at most about `bound` small rows, whatever the corpus holds,
    so that side is broadcast.
    """
    known = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder("doc_id", fold) != held))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    rate = min(1.0, bound / max(1, known.count()))
    sampled = known.where(share("doc_id", 11) < rate).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", F.struct("text", *more).alias("_row")).join(F.broadcast(sampled), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "y").agg(F.min("_row").alias("_row")).select("doc_id", "y", "_row.*")
