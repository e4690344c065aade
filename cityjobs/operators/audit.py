"""Audit and cleanup of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .urls import any_of, cap_per_group, fresh, is_foreign_language_url

CHECKS = ["heading_path", "bad_url", "mid_word", "display_has_heading", "embed_lacks_heading"]
BUCKETS = ["<100", "100-399", "400-600", "601-1000", ">1000"]


def audit_flags(chunks: DataFrame) -> DataFrame:
    """Adds a boolean for each check and the array of failed ones. Parents and statutes may start mid-word."""
    heading, display = F.coalesce("heading_path", F.lit("")), F.coalesce("display_text", F.lit(""))
    later = F.coalesce(F.col("chunk_index").try_cast("int"), F.lit(0)) > 0
    begins = lambda text: F.regexp_replace(text, r"(?U)^\s+", "").startswith(heading)
    flags = {
        "heading_path": ~heading.rlike(r"(?U)\S"),
        "bad_url": ~F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(False)),
        "mid_word": later & ~F.col("doc_type").eqNullSafe("statute") & display.rlike(r"(?U)^\s*[a-zäöüß]{3}"),
        "display_has_heading": (heading != "") & begins(display),
        "embed_lacks_heading": (heading != "") & ~begins(F.coalesce("embed_text", F.lit(""))),
    }
    failed = F.array_compact(F.array(*[F.when(f, F.lit(name)) for name, f in flags.items()]))
    return chunks.withColumns({f"fail_{k}": v for k, v in flags.items()} | {"failed": failed})


def audit_summary(chunks: DataFrame) -> DataFrame:
    """(category, source, check, fails, total, pct): fails of each check by source, of each over all, and all fails.

    total: the chunks of the source, or all of them; pct: fails for each hundred of those. Checks that no chunk of a
    source fails have no row. One pass counts by source; what follows is a row a source.
    """
    counts = [F.count_if(f"fail_{c}").alias(c) for c in CHECKS]
    small = audit_flags(chunks).groupBy("category", "source").agg(F.count("*").alias("total"), *counts)
    checks = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("fails"), F.lit(k == 0).alias("once")) for k, c in enumerate(CHECKS)]))
    rows = small.select("category", "source", "total", checks.alias("c")).select("category", "source", "total", "c.*")
    found = rows.groupingSets([["category", "source", "check"], ["check"], []], "category", "source", "check").agg(
        F.sum("fails").alias("fails"), F.when(F.grouping("check") == 1, F.sum(F.when(F.col("once"), F.col("total")))).otherwise(F.sum("total")).alias("total")
    )
    return found.where("fails > 0").withColumn("pct", F.round(100 * F.col("fails") / F.col("total"), 2))


def audit_top_offenders(chunks: DataFrame, n: int = 15) -> DataFrame:
    counts = [F.count_if(f"fail_{c}").alias(f"n_{c}") for c in CHECKS]
    rows = audit_flags(chunks).groupBy("category", "source").agg(F.count("*").alias("total_chunks"), F.sum(F.size("failed")).alias("fails"), *counts)
    return rows.where("fails > 0").orderBy(F.desc("fails"), "category", "source").limit(n)


def token_bucket(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return F.when(n < 100, BUCKETS[0]).when(n < 400, BUCKETS[1]).when(n <= 600, BUCKETS[2]).when(n <= 1000, BUCKETS[3]).otherwise(BUCKETS[4])


def token_histogram(chunks: DataFrame) -> DataFrame:
    """(bucket, n, share)."""
    counts = chunks.groupBy(token_bucket(F.col("token_count")).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("bucket", "n", F.round(F.col("n") / F.col("_all"), 4).alias("share"))


def audit_examples(chunks: DataFrame, n: int = 5, more: int = 10) -> DataFrame:
    """The first n failing chunks of each check, `more` of mid_word and of oversize (over 1000 tokens), by chunk_id."""
    over = F.when(F.coalesce("token_count", F.lit(0)) > 1000, F.array(F.lit("oversize"))).otherwise(F.array().cast("array<string>"))
    rows = audit_flags(chunks).select("chunk_id", F.explode(F.concat("failed", over)).alias("check"))
    rank = F.row_number().over(W.partitionBy("check").orderBy("chunk_id"))
    # the plain limit is what Spark applies before the shuffle, in every task
    first = rows.withColumn("_n", rank).where(F.col("_n") <= max(n, more))
    return first.where(F.col("_n") <= F.when(F.col("check").isin("mid_word", "oversize"), more).otherwise(n)).drop("_n")


def type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("doc_type") == "statute").alias("statutes"), F.count_if(F.col("doc_type") == "procedure").alias("procedures"))


def stratified_sample(df: DataFrame, by: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of each stratum in the order of a hash of key and seed. Each salted part of a stratum gives its first n, so
    none meets in a task.
    """
    h, part = fresh(df, "_h"), fresh(df, "_p")
    order = [F.col(h), F.col(key)]
    mixed = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    some = cap_per_group(df.withColumn(h, mixed).withColumn(part, F.pmod(F.xxhash64(h), F.lit(64))), [by, part], n, order)
    return cap_per_group(some, [by], n, order).drop(h, part)


def is_unwanted_section(url: Column, source: Column, of: str, allow: list[str], deny: list[str]) -> Column:
    """Only pages of the source `of`; allowed parts win over denied ones, unknown ones stay."""
    return F.coalesce((source == of) & ~any_of([url.contains(a) for a in allow], False) & any_of([url.contains(d) for d in deny], False), F.lit(False))


def cleanup_reason(unwanted: Column) -> Column:
    """The first reason that holds; null for chunks that stay."""
    return F.when(is_foreign_language_url(F.coalesce("source_url", F.lit(""))), "foreign_language").when(unwanted, "unwanted_section")


def cleanup_report(chunks: DataFrame, unwanted: Column) -> DataFrame:
    """(reason, n) and the totals: all, remaining."""
    judged = chunks.select(cleanup_reason(unwanted).alias("reason"))
    rows = judged.groupBy(F.coalesce("reason", F.lit("remaining")).alias("reason")).agg(F.count("*").alias("n"))
    return rows.unionByName(judged.agg(F.count("*").alias("n")).select(F.lit("total").alias("reason"), "n"))


def cleanup_apply(chunks: DataFrame, unwanted: Column) -> DataFrame:
    return chunks.where(cleanup_reason(unwanted).isNull())
