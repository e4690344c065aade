"""One source's landed pages to checked chunks: the whole job, with the source's own rules as columns."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Counter, chunk_documents, validate_chunks, word_counter
from .pages import HtmlProfile, classify_doc_type, drop_tail_sections, extract_sections


@dataclass(frozen=True)
class Source:
    """A source and its rules. Each rule gives a column: link_filter(url) which pages are taken, title_transform(title,
    url), tags_for(title, text) an array, subcategory_for(url). tail: headings from which on sections are left out.
    """

    category: str
    slug: str
    name: str
    authority: str
    language: str
    day: datetime.date
    ttl_days: int | None = None
    link_filter: Callable[[Column], Column] | None = None
    title_transform: Callable[[Column, Column], Column] | None = None
    tags_for: Callable[[Column, Column], Column] | None = None
    subcategory_for: Callable[[Column], Column] | None = None
    profile: HtmlProfile = HtmlProfile()
    tail: tuple[str, ...] = ()
    least: int = 300


def documents_of(pages: DataFrame, source: Source, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Documents of the pages that the source takes, and (source_url, category, source, reason) of pages left out.

    A page without title or with less than `least` letters of text is left out (no_content); one that the link filter
    turns down is not the source's and counts nowhere.
    """
    taken = pages if source.link_filter is None else pages.where(source.link_filter(F.col(url)))
    found = extract_sections(taken.select(F.col(url).alias("source_url"), F.col(html).alias("html")), "html", source.profile).drop("html")
    if source.tail:
        cut = drop_tail_sections(F.col("sections"), list(source.tail))
        found = found.withColumn("sections", cut).withColumn("full_text", F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n"))
    good = (F.col("title") != "") & (F.length("full_text") >= source.least)
    placed = {"category": F.lit(source.category), "source": F.lit(source.slug)}
    left_out = found.where(~good).select("source_url", *[c.alias(n) for n, c in placed.items()], F.lit("no_content").alias("reason"))
    title = F.col("title") if source.title_transform is None else source.title_transform(F.col("title"), F.col("source_url"))
    none = F.lit(None).cast("string")
    docs = found.where(good).withColumn("title", title)
    docs = docs.select(
        "source_url", F.lit(source.name).alias("source_name"), "title", F.lit(source.language).alias("language"), *[c.alias(n) for n, c in placed.items()], F.lit(source.authority).alias("authority"),
        classify_doc_type(F.transform("sections", lambda s: s["heading"]), F.col("full_text")).alias("doc_type"), "sections",
        (none if source.subcategory_for is None else source.subcategory_for(F.col("source_url"))).alias("subcategory"),
        (F.array().cast("array<string>") if source.tags_for is None else source.tags_for(F.col("title"), F.col("full_text"))).alias("tags"),
        F.lit(source.day).alias("created_at"), F.lit(source.day).alias("updated_at"), F.lit(source.ttl_days).cast("int").alias("ttl_days"),
    )
    return docs, left_out


def ingest(pages: DataFrame, source: Source, url: str = "url", html: str = "html", counter: Counter = word_counter) -> tuple[DataFrame, DataFrame]:
    """Chunks that keep all rules, and what was left out: pages without content, and chunks that break a rule by their documents.

    Both are lazy and read the pages again: checkpoint or write the chunks, see sources.files and pages.ingest_summary.
    """
    docs, left_out = documents_of(pages, source, url, html)
    good, bad = validate_chunks(chunk_documents(docs, counter))
    broken = bad.select("source_url", "category", "source", F.array_join("reasons", ",").alias("reason")).distinct()
    return good, left_out.unionByName(broken)
