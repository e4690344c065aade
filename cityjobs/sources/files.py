"""Readers and writers of chunk trees, feeds and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in "chunk_id doc_id chunk_index parent_chunk_id source_url source_name title heading_path language subcategory authority doc_type chunk_shape display_text embed_text entity_name entity_type address law_name abbrev sr_number ls_number article_number paragraph period district license".split()]
    + [T.StructField(n, T.IntegerType()) for n in "token_count ttl_days schema_version step_index".split()]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("created_at", T.DateType()), T.StructField("updated_at", T.DateType())]
)
EVAL_SCHEMA = "persona_id string, seed string, transcript array<struct<role:string,content:string>>, latencies_s array<double>, errors array<string>, verdict struct<scores:map<string,double>,rationale:map<string,string>,patterns:array<string>,connector_gap:string,kb_gap:string,worst_turn_idx:int,error:string>"


def read_chunks(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """Chunks under category=.../source=.../, as write_chunks lays them out: both are partition columns, so that a filter on
    them reads only its folders. In Parquet a filter on other columns also skips files by their statistics.
    """
    placed = T.StructType([*CHUNK_SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ("category", "source"))])
    return spark.read.schema(placed).option("pathGlobFilter", "*.json*" if fmt == "json" else "*").format(fmt).load(root)


def read_plain_chunks(spark: SparkSession, root: str, category: str = "*", source: str = "*") -> DataFrame:
    """JSON lines under plain folders category/source/, of one category or source if given; files that lie higher are
    ignored. Plain names are no partitions for Spark, so the folders to read are named in the path.
    """
    rows = spark.read.schema(CHUNK_SCHEMA).option("pathGlobFilter", "*.json*").json(f"{root.rstrip('/')}/{category}/{source}")
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/([^/]+)/[^/]+$", i)
    return rows.withColumn("category", part(1)).withColumn("source", part(2))


def write_chunks(df: DataFrame, root: str, fmt: str = "json", files: int = 8) -> None:
    """Partition files by category and source, `files` at most for each; whole partitions are replaced.

    What is written must hold all documents of the partitions that it touches: take it from upsert_docs.
    """
    if df.isEmpty():
        raise ValueError("no chunks to write")
    salted = df.repartition("category", "source", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("category", "source").format(fmt).save(root)


def read_open_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; byte-order marks, quotes and blanks go from the names."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*[c.replace("﻿", "").strip().strip('"').strip() for c in df.columns])


def parse_feed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Landed JSON parsed with a fixed schema; what does not parse is null."""
    return df.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def read_bath_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = "title string, temperatureWater double, openClosedTextPlain string, openingHoursText string, dateModified string, urlPage string"
    return spark.read.format("xml").option("rowTag", "bath").schema(schema).load(path)


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).json(path)


def write_eval_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_year(name: Column) -> Column:
    return F.regexp_extract(name, r"((?:19|20)\d{2})", 1).try_cast("int")
