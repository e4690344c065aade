"""Lines that many documents share, found by levelled sorted runs of line hashes and dropped everywhere.

A run is a Parquet table of (line, n) with one row for each line hash, sorted and bucketed by the hash. Documents come in
batches. A batch merge-anti-joins the lines that the runs know as common already, counts its other lines and adds them
as a run of level 0; when a level holds two runs they are merged into one of the level above, so that a line is
rewritten as often as there are levels. Runs are bucketed alike: neither the anti-join nor the merge, a full outer merge
join of two, shuffles them. Everything is a DataFrame or SQL function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, shared_folder

LEAST, BATCHES = 10, 4
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many common lines, of 16 bytes each, are sent to all tasks; more are joined by a shuffle of hashes.
COMMON_SENT = 250_000


def lines_of(text: str | Column) -> Column:
    """The lines between \\n; one empty line for null and empty texts."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Without blanks at both ends, A-Z in lower case; letters beyond ASCII stay as they are."""
    ascii_only = F.length(line) == F.octet_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(BLANKS))


def hashes(text: str) -> Column:
    """128 bits, as text, of each line's key; null for empty keys."""
    return F.transform(lines_of(text), lambda x: F.md5(F.nullif(line_key(x), F.lit("")).cast("binary")))


class LineRuns:
    """The runs of what has come so far. They are tables of a database of their own in the shared folder, so they outlive
    lost executors; one that is merged is dropped with its files.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, buckets: int | None = None) -> None:
        self.spark, self.least = spark, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[str | None] = []
        self.made = 0
        spark.sql(f"create database {self.database} location '{shared_folder(spark)}/{self.database}'")

    def write(self, counts: DataFrame) -> str:
        """counts: (line, n), one row a line. Lines that are common already are a partition of their own."""
        self.made += 1
        name = f"{self.database}.run_{self.made}"
        rows = counts.select("line", "n", (F.col("n") >= self.least).alias("common"))
        rows.write.partitionBy("common").bucketBy(self.buckets, "line").sortBy("line").format("parquet").saveAsTable(name)
        return name

    def names(self) -> list[str]:
        return [name for name in self.levels if name]

    def merge(self, one: str, other: str) -> str:
        """A run of the lines of two, which go."""
        a, b = (self.spark.table(name).select("line", F.col("n").alias(n)) for name, n in ((one, "_a"), (other, "_b")))
        both = a.hint("merge").join(b, "line", "full_outer")
        found = self.write(both.select("line", (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("n")))
        for name in (one, other):
            self.spark.sql(f"drop table {name}")
        return found

    def add(self, batch: DataFrame, text: str = "text") -> None:
        """Counts a batch: each row counts once for each of its distinct lines. Null and empty texts add nothing."""
        met = batch.select(F.explode(F.array_compact(F.array_distinct(hashes(text)))).alias("line"))
        counts = met.select(F.unhex("line").alias("line")).groupBy("line").agg(F.count("*").alias("n"))
        for name in self.names():
            counts = counts.join(self.spark.table(name).where("common").select("line"), "line", "left_anti")
        run = self.write(counts)
        for level, older in enumerate(self.levels):
            if older is None:
                self.levels[level] = run
                return
            run, self.levels[level] = self.merge(older, run), None
        self.levels.append(run)

    def common(self) -> DataFrame:
        """(line): hashes of the lines that at least `least` rows of all batches hold. All levels are merged into one."""
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], "line binary")
        run = names[0]
        for name in names[1:]:
            run = self.merge(run, name)
        self.levels = [None] * (len(self.levels) - 1) + [run]
        return self.spark.table(run).where("common").select("line")

    def close(self) -> None:
        self.spark.sql(f"drop database {self.database} cascade")


def batches_of(docs: DataFrame, most: int = BATCHES) -> list[DataFrame]:
    """A table's files in at most `most` batches of as many files each; a table of one file is one batch."""
    files = sorted(docs.inputFiles())
    n = min(most, len(files))
    if n < 2:
        return [docs]
    reader = docs.sparkSession.read.schema(docs.schema)
    return [reader.parquet(*files[k::n]) for k in range(n)]


def without(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): texts without their common lines.

    Only places of dropped lines meet the rows again. A row is known by its doc_id, null or not, and a hash of its text.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    lines = rows.select("doc_id", "_hash", F.posexplode(hashes("text")).alias("_at", "line")).where("line is not null")
    few = common.limit(COMMON_SENT + 1).count() <= COMMON_SENT
    hits = lines.withColumn("line", F.unhex("line")).join(F.broadcast(common) if few else common, "line", "left_semi")
    places = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_key")).agg(F.array_sort(F.collect_set("_at")).alias("_at"))
    found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    found = found.select("doc_id", lines_of("text").alias("_lines"), F.coalesce("_at", F.array().cast("array<int>")).alias("_at"))
    # the stretches between dropped places, joined: linear in the lines, however many of them go
    after, before = F.concat(F.array(F.lit(-1)), "_at"), F.concat("_at", F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(after, before, lambda a, b: F.slice("_lines", a + 2, b - a - 1)))
    return found.select("doc_id", F.array_join(kept, "\n").alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.size("_at").cast("long").alias("n_dropped"))


def drop_common_lines(docs: DataFrame, batches: list[DataFrame] | None = None, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), a row for each row: without the lines that `least` rows or more hold.

    batches: the rows of docs in parts (one without). A null or empty text is one empty line, which has no key and stays.
    Rows that repeat a doc_id, or have none, count one by one; so do rows that are equal in all. A line counts once a row. An
    empty table gives an empty one; other columns of docs are not read.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, least)
    for batch in batches or [docs]:
        runs.add(batch)
    path = scratch(spark, "common_lines")
    runs.common().write.parquet(path)
    runs.close()
    return without(docs, spark.read.schema("line binary").parquet(path))
