"""URL work: filter, route, dedupe, cap, links."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keywords import FEW, scanned
from .markup import links

#: Every sign of Unicode's class of blanks (Zs): what SQL's trim takes off.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(parts: Column) -> Column:
    """Strings of an array without blanks at their ends; empty ones go. F.trim itself in F.transform takes the place as
    what to take off.
    """
    return F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")


@dataclass(frozen=True)
class UrlRules:
    prefixes: tuple[str, ...] = ()
    skip_prefixes: tuple[str, ...] = ()
    skip_parts: tuple[str, ...] = ()
    skip_extensions: tuple[str, ...] = ()
    min_depth: int = 0
    max_depth: int = 99
    keywords: tuple[str, ...] = field(default=())


def any_of(tests: list[Column], empty: bool) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(empty)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def path(url: Column) -> Column:
    """Path without query and fragment; '' if there is none."""
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def url_keeps(url: Column, rules: UrlRules) -> Column:
    depth = F.size(segments(url))
    keep = any_of([url.startswith(p) for p in rules.prefixes], True)
    keep = keep & ~any_of([url.startswith(p) for p in rules.skip_prefixes], False)
    keep = keep & ~any_of([url.contains(p) for p in rules.skip_parts], False)
    keep = keep & ~any_of([F.lower(path(url)).endswith(e) for e in rules.skip_extensions], False)
    keep = keep & depth.between(rules.min_depth, rules.max_depth)
    return keep & any_of([F.lower(path(url)).contains(k) for k in rules.keywords], True)


def url_filter(df: DataFrame, url: str, rules: UrlRules) -> DataFrame:
    return df.where(url_keeps(F.col(url), rules))


def route_category(df: DataFrame, url: str, rules: list[tuple[str, str | None]], default: str | None = None, name: str = "category") -> DataFrame:
    """The category of the first rule whose prefix the path has; a rule without category drops the row."""
    p, out = path(F.col(url)), F.lit(default)
    for prefix, category in reversed(rules):
        out = F.when(p.startswith(prefix), F.lit(category)).otherwise(out)
    return df.withColumn(name, out).where(F.col(name).isNotNull())


def route_by_segment(df: DataFrame, url: str, lookup: dict[str, str | None], default: str | None = None, name: str = "category") -> DataFrame:
    """The category of the path's first segment; a segment without category, or with none and no default, drops the row."""
    first = F.try_element_at(segments(F.col(url)), F.lit(1))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair]), F.coalesce(first, F.lit("")))
    listed = F.coalesce(first.isin(list(lookup)), F.lit(False))
    return df.withColumn(name, F.when(listed, named).otherwise(F.lit(default))).where(F.col(name).isNotNull())


def derive_subcategory(category: Column, url: Column, segment: int) -> Column:
    """category/leaf of one path segment (from 1, or -1 for the last); null if nothing is left of it."""
    leaf = F.try_element_at(segments(url), F.lit(segment))
    leaf = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(leaf, r"\.html$", ""), "-", "_"), "[^A-Za-z0-9_]", ""), 1, 40)
    return F.when(F.length(leaf) > 0, F.concat_ws("/", category, F.lower(leaf)))


def first_keyword_label(text: Column, pairs: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pair whose keyword the text contains. A long list is one automaton, which reads a text once."""
    if len(pairs) > FEW:
        words = list(dict.fromkeys(k for k, _ in pairs))
        labels = dict(reversed(pairs))
        return F.coalesce(scanned(text, words, lambda met: labels[words[min(met)]] if met else None, "string"), F.lit(default))
    out = F.lit(default)
    for keyword, label in reversed(pairs):
        out = F.when(text.contains(keyword), F.lit(label)).otherwise(out)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def dedupe_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return cap_per_group(df, key, 1, order)


def priority_limit(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cap_per_group(df: DataFrame, group: list[str], n: int, order: list[Column]) -> DataFrame:
    place = fresh(df, "_n")
    return df.withColumn(place, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(place) <= n).drop(place)


def rank_in_group(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's number in its group by `order`, from 1, without a task that holds a group.

    Rows are dealt in ranges of (group, order) and sorted; what earlier ranges hold of a group is added to a row's
    place in its own range. Only one row for each range and group is windowed. `order` must tell a group's rows apart.
    """
    keep_checkpoints(df.sparkSession)
    place = F.monotonically_increasing_id()
    at, part, first, size, add = (fresh(df, c) for c in ("_at", "_range", "_first", "_size", "_add"))
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn(at, place).withColumn(part, F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy(*group, part).agg(F.min(at).alias(first), F.count("*").alias(size))
    earlier = F.sum(size).over(W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    other = {c: fresh(dealt, f"_of_{c}") for c in (*group, part)}
    parts = parts.select(*[F.col(c).alias(o) for c, o in other.items()], (F.coalesce(earlier, F.lit(0)) - F.col(first) + 1).alias(add))
    found = dealt.join(parts, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
    return found.select(*df.columns, (F.col(at) + F.col(add)).alias(name))


def keep_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of this machine in local mode, as in tests; an
    error on a cluster, whose executors share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def cap_share(df: DataFrame, category: str, source: str, share: float, order: list[str]) -> DataFrame:
    """At most `share` of a category's rows (rounded down, one at least) from any of its sources, the first by `order`."""
    place, most, own = (fresh(df, c) for c in ("_n", "_most", "_c"))
    sizes = df.groupBy(F.col(category).alias(own)).agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias(most))
    ranked = rank_in_group(df, [category, source], order, place)
    return ranked.join(sizes, F.col(category).eqNullSafe(F.col(own))).where(F.col(place) <= F.col(most)).drop(place, most, own)


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def latest_edition(df: DataFrame, key: str, href: str) -> DataFrame:
    """For each key the href with the highest 4-digit year in it; the smallest of those."""
    year = F.regexp_extract(href, r"((?:19|20)\d{2})", 1).try_cast("int")
    found = df.withColumn("year", F.coalesce(year, F.lit(0)))
    return dedupe_first(found, [key], [F.desc("year"), F.col(href)]).select(key, href, "year")


def absolute_link(url: Column, link: Column) -> Column:
    """Absolute links as they are, /x on the page's host by https, others null; no fragment, no slash at the end."""
    base = F.concat(F.lit("https://"), F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    full = F.when(link.rlike("^https?://"), link).when(link.startswith("/") & ~link.startswith("//"), F.concat(base, link))
    return F.regexp_replace(F.regexp_replace(full, "#.*$", ""), "/+$", "")


def hrefs(html: Column) -> Column:
    """The links of a page in order, whatever their quotes, entities resolved; one pass over the page."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([links(t) if t is not None else None for t in texts], dtype=object)

    return run(html)


def extract_links(pages: DataFrame, url: str, html: str, prefix: str = "") -> DataFrame:
    """(src, dst), one row a distinct link of a page."""
    found = pages.select(F.col(url).alias("src"), F.explode(hrefs(F.col(html))).alias("link"))
    return found.select("src", absolute_link(F.col("src"), F.col("link")).alias("dst")).where(F.col("dst").startswith(prefix)).distinct()


def bfs_reach(links: DataFrame, seeds: DataFrame, max_depth: int, failed: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
    """(node, depth) of what `seeds` (node) reach over links (src, dst); failed nodes are neither counted nor expanded.

    With max_pages the first by depth, then by node. One join a level; a level is written once, by checkpoint(), and what was
    seen is the levels so far.
    """
    keep_checkpoints(links.sparkSession)
    bad = failed.select("node").distinct() if failed is not None else seeds.select("node").where("false")
    edges = links.select("src", "dst").distinct().checkpoint()
    room = max_pages

    def first(level: DataFrame) -> DataFrame:
        return (level if room is None else level.orderBy("node").limit(room)).checkpoint()

    front = first(seeds.select("node").distinct().join(bad, "node", "left_anti").withColumn("depth", F.lit(0)))
    seen, n = front, front.count()
    for depth in range(1, max_depth + 1):
        room = None if room is None else room - n
        if room == 0 or not n:
            break
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = first(step.join(seen.select("node"), "node", "left_anti").join(bad, "node", "left_anti").withColumn("depth", F.lit(depth)))
        n, seen = front.count(), seen.unionByName(front)
    return seen


FOREIGN = r"(?i)/(fr|it|en|rm)/|/lang/(fr|it|en)/|\?(lang|language)=(fr|it|en|rm)"


def is_foreign_language_url(url: Column) -> Column:
    return url.rlike(FOREIGN)


#: The entities of XML.
XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def sitemap_urls(df: DataFrame, xml: str) -> DataFrame:
    """(loc, is_index) of all <loc> entries of landed sitemaps, entities resolved."""
    loc = F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("loc")
    found = df.select(loc, F.col(xml).contains("<sitemapindex").alias("is_index"))
    text = F.col("loc")
    for entity, sign in XML_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return found.select(text.alias("loc"), "is_index")
