"""Rows and probes that meet inside the cells of an index, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(key: str, count: Column, most: int) -> Column:
    """A place among as many as hold `most` rows each."""
    return F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(count / most)))


def others(count: Column, most: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(count / most)) - 1))


def meet(rows: DataFrame, row_key: str, probes: DataFrame, probe_key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most_rows: int = 8_192, most_probes: int = 2_048) -> DataFrame:
    """run(rows, probes) over each cell that has both. Both tables have a column `cell`; keys tell their rows apart.

    A cell of more rows or probes than one group takes is cut: its rows into parts, its probes into blocks, and each
    part meets each block in a group of its own. So no group grows with the cell, and every row meets every probe of its
    cell once. One row for each cell is sent to all tasks: the index must bound the number of cells.
    """
    n_rows, n_probes = rows.groupBy("cell").agg(F.count("*").alias("_rows")), probes.groupBy("cell").agg(F.count("*").alias("_probes"))
    sizes = F.broadcast(n_rows.join(n_probes, "cell"))
    left = rows.join(sizes, "cell").withColumn("_part", dealt(row_key, F.col("_rows"), most_rows)).withColumn("_block", others(F.col("_probes"), most_probes)).drop("_rows", "_probes")
    right = probes.join(sizes, "cell").withColumn("_block", dealt(probe_key, F.col("_probes"), most_probes)).withColumn("_part", others(F.col("_rows"), most_rows)).drop("_rows", "_probes")
    group = ["cell", "_part", "_block"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema)
