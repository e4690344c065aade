"""A chunk table in buckets of documents, of which an upsert rewrites only those it touches.

    data/version=V/bucket=K/...   the chunks of bucket K, written whole by batch V
    manifest/batch=B/...          (bucket, version) of the buckets that batch B wrote

A bucket's current version is that of its latest batch in the manifest. Writing a manifest is the commit: what a batch
that failed has left under its version is overwritten when it comes again, and a batch that is in the manifest changes
nothing. Readers see the buckets as of the last commit.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import upsert_docs

MANIFEST = "bucket int, version long, batch long"
#: The version of a bucket whose last document went.
EMPTY = -1


def bucket_of(doc_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


class ChunkStore:
    """buckets is fixed for the life of a store: as many as keep a bucket within a few hundred megabytes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def versions(self) -> dict[int, int]:
        """The current version of each bucket that has one; a row a bucket comes to the driver."""
        rows = self.manifest().groupBy("bucket").agg(F.max_by("version", "batch").alias("version")).where(F.col("version") != EMPTY)
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def of_buckets(self, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        """All chunks; an error on a store that nothing was written to."""
        found = self.of_buckets(self.versions())
        if found is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return found

    def touched(self, *tables: DataFrame) -> list[int]:
        """The buckets of these tables' documents: at most as many rows as the store has buckets."""
        found: set[int] = set()
        for df in tables:
            found |= {r[0] for r in df.select(bucket_of("doc_id", self.buckets)).distinct().collect()}
        return sorted(found)

    def upsert(self, new_chunks: DataFrame, batch: int, deleted: DataFrame | None = None) -> list[int]:
        """Replaces whole documents by their chunks in new_chunks and takes out those of `deleted` (doc_id); the
        buckets written. A batch that was committed before changes nothing. Batches come in ascending order.

        new_chunks is read twice: keep it on disk if it is dear.
        """
        if not self.manifest().where(F.col("batch") == batch).isEmpty():
            return []
        gone = [] if deleted is None else [deleted]
        touched, versions = self.touched(new_chunks, *gone), self.versions()
        if not touched:
            return []
        stored = self.of_buckets({b: versions[b] for b in touched if b in versions})
        rows = new_chunks if stored is None else upsert_docs(stored, new_chunks.select(*stored.columns), deleted)
        placed = rows.withColumn("bucket", bucket_of("doc_id", self.buckets)).repartition(len(touched), "bucket").sortWithinPartitions("bucket", "doc_id")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={batch}")
        written = self.spark.read.schema("doc_id string, bucket int").parquet(f"{self.path}/data/version={batch}")
        filled = {r[0] for r in written.select("bucket").distinct().collect()}  # a bucket without documents has no folder
        self.commit([(b, batch if b in filled else EMPTY) for b in touched], batch)
        return touched

    def commit(self, rows: list[tuple[int, int]], batch: int) -> None:
        manifest = self.spark.createDataFrame(rows, "bucket int, version long").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
