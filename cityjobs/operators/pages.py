"""Landed pages and page texts to typed documents."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keywords import FEW, scanned
from .markup import END, START, tokens
from .urls import any_of, fresh, trimmed

SECTION = "array<struct<heading:string,text:string,level:int>>"
STEP = r"(?i)(schritt|etappe|step|étape|fase)\s*\d"


@dataclass(frozen=True)
class HtmlProfile:
    """What a site needs beyond the plain rules.

    drop: classes and ids of elements that go. rename: tags that count as others. levels: a tag that is a heading of
    the level in its `level` attribute (2 to 4). folds: a tag whose `heading` or `label` attribute is a heading of
    level 3 over its text. bogus: lower-cased h1 texts that are none ('*': all). title_from: 'h1', 'og' (og:title
    first) or 'h2'. title_suffix: goes from the end of titles that are no h1. root: (tag, mark) of the part that counts, its
    class or id holding the mark; with largest the one with the most text of several, else the first.
    """

    drop: frozenset[str] = frozenset()
    rename: dict[str, str] = field(default_factory=dict)
    levels: str = ""
    folds: str = ""
    bogus: frozenset[str] = frozenset()
    title_from: str = "h1"
    title_suffix: str = ""
    root: tuple[str, str] | None = None
    largest: bool = False


class _Part:
    """An element whose text is wanted: its texts are a stretch of the page's, of all or of those that count."""

    def __init__(self, tag: str, stripped: bool, start: int, fixed: str | None = None) -> None:
        self.tag, self.stripped, self.start, self.end, self.fixed = tag, stripped, start, start, fixed


class _Sections:
    """Title and sections of one page. A new block closes an open <p>, a new <li> an open one.

    Where open elements stand is kept by tag, so that a tag finds its element without a walk; texts are kept once, in
    order. Of parts inside parts the DEPTH outermost are told apart, and the text of deeper ones is theirs. So time and
    memory follow the page's length.
    """

    SKIP = frozenset("script style nav header footer aside noscript iframe".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    CLOSES_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl div section article table form blockquote pre main header footer nav aside".split())
    PARTING = ("div", "td", "section", "article", "main", "body")
    WANTED = frozenset("h1 h2 h3 p li title".split())
    ROOT, BODY, MAIN = 0, 1, 2
    DEPTH = 32

    def __init__(self, profile: HtmlProfile) -> None:
        self.profile, self.og = profile, ""
        self.stack: list[tuple[str, bool, bool, int | None, _Part | None]] = []  # tag, strips, gone, scope, part
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
        self.skip = self.dropped = self.depth = 0
        self.parts: list[_Part] = []
        self.every: list[str] = []  # texts, and of those the ones that count, with their letters added up
        self.texts: list[str] = []
        self.letters = [0]
        self.scopes: dict[int, list[int]] = {self.ROOT: [0, 0, -1, -1]}  # first part and text, and behind the last
        self.roots: list[int] = []

    def read(self, html: str) -> dict:
        for kind, name, named in tokens(html):
            if kind == START:
                self.begin(name, named)
            elif kind == END:
                self.finish(name)
            else:
                self.say(name)
        self.cut(0)
        self.close(self.ROOT)
        return self.result()

    def begin(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        profile, named = self.profile, {}
        for k, v in attributes:
            named.setdefault(k, v or "")
        tag = profile.rename.get(tag, tag)
        if tag == "meta" and named.get("property") == "og:title":
            self.og = self.og or named.get("content", "").strip()
        if tag in self.VOID:
            return
        if profile.levels and tag == profile.levels:
            level = named.get("level", "2")
            tag = f"h{min(4, max(2, int(level) if level.isdigit() else 2))}"
        if tag in self.CLOSES_P:
            self.shut("p", "li")
        if tag == "li":
            self.shut("li", "ul", "ol")
        marks = {named.get("id", ""), *named.get("class", "").split()} - {""}
        gone = bool(marks & profile.drop)
        strips = gone or tag in self.SKIP
        self.skip += strips
        self.dropped += gone
        scope = None
        if not self.skip:
            if tag == "body" and self.BODY not in self.scopes:
                scope = self.BODY
            elif tag == "main" and self.MAIN not in self.scopes:
                scope = self.MAIN
            elif profile.root and tag == profile.root[0] and any(profile.root[1] in m for m in marks):
                scope = 3 + len(self.roots)
                self.roots.append(scope)
        if scope is not None:
            self.scopes[scope] = [len(self.parts), len(self.texts), -1, -1]
        part = None
        if profile.folds and tag == profile.folds and not self.skip:
            heading = (named.get("heading") or named.get("label") or "").strip()
            if heading:
                self.parts.append(_Part("h3", False, 0, heading))
            tag, part = "fold:" + tag, self.part("p")
        elif tag in self.WANTED and not self.dropped:
            part = self.part(tag)
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, strips, gone, scope, part))

    def part(self, tag: str) -> _Part | None:
        if self.depth == self.DEPTH:
            return None
        self.depth += 1
        stripped = self.skip > 0
        self.parts.append(_Part(tag, stripped, len(self.every if stripped else self.texts)))
        return self.parts[-1]

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def shut(self, tag: str, *within: str) -> None:
        """Closes an open element of this kind that no element of the other kinds parts from here."""
        at = self.last(tag)
        if at > self.last(*within, *self.PARTING):
            self.cut(at)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, strips, gone, scope, part = self.stack.pop()
            self.places[tag].pop()
            self.skip -= strips
            self.dropped -= gone
            if scope is not None:
                self.close(scope)
            if part is not None:
                self.depth -= 1
                part.end = len(self.every if part.stripped else self.texts)

    def close(self, scope: int) -> None:
        self.scopes[scope][2:] = len(self.parts), len(self.texts)

    def finish(self, tag: str) -> None:
        tag = self.profile.rename.get(tag, tag)
        at = self.last(*(("fold:" + tag,) if tag == self.profile.folds else ("h2", "h3", "h4") if tag == self.profile.levels and tag else (tag,)))
        if at >= 0:
            self.cut(at)

    def say(self, text: str) -> None:
        text = text.strip()
        if text and not self.dropped:
            self.every.append(text)
            if not self.skip:
                self.texts.append(text)
                self.letters.append(self.letters[-1] + len(text))

    def filled(self, part: _Part) -> bool:
        return part.fixed is not None or part.end > part.start

    def text_of(self, part: _Part) -> str:
        return part.fixed if part.fixed is not None else " ".join((self.every if part.stripped else self.texts)[part.start : part.end])

    def scope(self) -> int:
        if self.roots:
            size = lambda s: self.letters[self.scopes[s][3]] - self.letters[self.scopes[s][1]]
            return max(self.roots, key=size) if self.profile.largest else self.roots[0]
        return max(s for s in self.scopes if s <= self.MAIN)

    def title(self) -> str:
        profile = self.profile
        bogus = lambda p: p.tag == "h1" and ("*" in profile.bogus or bool(profile.bogus) and self.text_of(p).lower() in profile.bogus)
        first = {tag: next((self.text_of(p) for p in self.parts if p.tag == tag and self.filled(p) and not bogus(p)), "") for tag in ("h1", "h2", "title")}
        bare = lambda t: t.removesuffix(profile.title_suffix).strip() if profile.title_suffix else t
        order = {"h1": (first["h1"], bare(self.og), bare(first["title"])), "og": (bare(self.og), first["h1"], bare(first["title"])), "h2": (first["h2"], bare(first["title"]))}[profile.title_from]
        return next((t for t in order if t), "")

    def result(self) -> dict:
        first, text, behind, last = self.scopes[self.scope()]
        sections, heading, level, texts = [], "", 2, []

        def flush() -> None:
            text = "\n\n".join(dict.fromkeys(texts))
            if text:
                sections.append({"heading": heading, "text": text, "level": level})

        for part in self.parts[first:behind]:
            if part.stripped:
                continue
            if part.tag in ("h2", "h3"):
                flush()
                heading, level, texts = self.text_of(part), int(part.tag[1]), []
            elif part.tag in ("p", "li") and self.filled(part):
                texts.append(self.text_of(part))
        flush()
        if not sections:
            whole = "\n".join(self.texts[text:last])
            sections = [{"heading": "", "text": whole, "level": 2}] if whole else []
        return {"title": self.title(), "sections": sections, "full_text": "\n\n".join(s["text"] for s in sections)}


def extract_sections(pages: DataFrame, html: str, profile: HtmlProfile | None = None) -> DataFrame:
    """Adds title, sections, full_text; columns of these names are replaced. A page's own row is all that is held.

    The title is the first h1, wherever it stands, else og:title, else the page's title. Navigation, headers, footers,
    asides, scripts and frames do not count (forms do); what counts is the first main, else the body. An h2 or h3 opens
    a section; its paragraphs and list items are joined, each once. Without any the whole text is one section of level 2.
    full_text is the sections' texts. Of elements inside each other the 32 outermost count as parts of their own, the text
    of deeper ones as theirs. A page is read once, from left to right. Null and empty pages have an empty title and text and no sections.
    """
    profile = profile or HtmlProfile()

    @F.pandas_udf(f"struct<title:string,sections:{SECTION},full_text:string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [_Sections(profile).read(text or "") for text in texts]
        return pd.DataFrame(rows, columns=["title", "sections", "full_text"])

    rest = [c for c in pages.columns if c not in ("title", "sections", "full_text")]
    return pages.select(*rest, parse(F.col(html)).alias("_x")).select(*rest, "_x.title", "_x.sections", "_x.full_text")


def drop_tail_sections(sections: Column, headings: list[str]) -> Column:
    """The sections before the first whose lower-cased heading is in the list."""
    places = F.transform(sections, lambda s, i: F.when(F.lower(s["heading"]).isin(headings), i))
    cut = F.array_min(F.array_compact(places))
    return F.slice(sections, F.lit(1), F.coalesce(cut, F.size(sections)).cast("int"))


def dedupe_paragraphs(text: Column) -> Column:
    return F.array_join(F.array_distinct(trimmed(F.split(text, r"\n+"))), "\n\n")


def min_text(df: DataFrame, title: str, text: str, n: int = 300) -> DataFrame:
    return df.where(F.col(title).isNotNull() & (F.col(title) != "") & (F.length(text) >= n))


def soft_404(html: Column) -> Column:
    return F.substring(html, 1, 20_000).contains("Error 404")


def region_filter(df: DataFrame, text: str, regex: str = r"\b8\d{3}\b") -> DataFrame:
    return df.where(F.col(text).rlike(regex))


def reference_body(sections_text: Column, full_text: Column, least: int = 200) -> Column:
    return F.when(F.length(sections_text) >= least, sections_text).otherwise(F.coalesce(full_text, F.lit("")))


def classify_doc_type(headings: Column, text: Column) -> Column:
    stepped = F.exists(headings, lambda h: h.rlike(STEP))
    numbered = text.rlike(r"(?m)^\s*\d+[.)]\s")
    return F.when(F.coalesce(stepped, F.lit(False)) | F.coalesce(numbered, F.lit(False)), "procedure").otherwise("article")


def fold_tag(keyword: str) -> str:
    for letter, pair in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), (" ", "_")):
        keyword = keyword.replace(letter, pair)
    return keyword


def tag_keywords(title: Column, text: Column, keywords: list[str], head: int = 500, mode: str = "substring", suffix: str = "", fold: bool = False, ordered: bool = False, fixed: Column | None = None) -> Column:
    """Keywords in the lower-cased title and head of the text, once each.

    mode word: the keyword between blanks, or followed by `suffix` ('s', 'en') and a blank. fold: umlauts and blanks of
    tags are written out. ordered: sorted, else in list order. fixed: an array of tags that come first. A long list is one
    automaton, which reads a text once.
    """
    seen = F.lower(F.concat(F.lit(" "), F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, head), F.lit(" ")))
    forms = {"substring": lambda k: [k], "word": lambda k: [f" {k} ", *([f"{k}{suffix} "] if suffix else [])]}[mode]
    keywords = list(dict.fromkeys(keywords))
    tags = [fold_tag(k) if fold else k for k in keywords]
    if len(keywords) <= FEW:
        test = lambda k: any_of([seen.contains(x) for x in forms(k)], False)
        found = F.array_compact(F.array(*[F.when(test(k), F.lit(tag)) for k, tag in zip(keywords, tags)])).cast("array<string>")
    else:
        words = [(x, n) for n, k in enumerate(keywords) for x in forms(k)]
        of: dict[str, list[int]] = {}
        for x, n in words:  # two keywords can have a form in common
            of.setdefault(x, []).append(n)
        places = list(of.values())
        found = scanned(seen, list(of), lambda met: [tags[n] for n in sorted({n for m in met for n in places[m]})], "array<string>")
    tags = F.array_distinct(found if fixed is None else F.concat(fixed, found))
    return F.array_sort(tags) if ordered else tags


def clean_page_text(text: Column, markers: bool = False) -> Column:
    """Hyphen breaks joined, single line breaks made spaces (not before § or Art. if markers), blank lines squeezed."""
    text = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"(?<!\n)\n(?!\n|§|Art\.)" if markers else r"(?<!\n)\n(?!\n)", " ")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def join_pages(df: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """(doc, text): pages in order, index pages left out. A row holds one document's pages, as its text does."""
    kept = df.where(~is_index_page(F.col(text)))
    pages = F.array_sort(F.collect_list(F.struct(page_no, text)))
    return kept.groupBy(doc).agg(F.array_join(F.transform(pages, lambda p: p[text]), "\n\n").alias("text"))


def is_index_page(text: Column) -> Column:
    """Four lines or more, over 70 % of under six words and over 40 % that start with a reference mark."""
    lines = trimmed(F.split(text, "\n"))
    n = F.size(lines)
    short = F.size(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) < 6))
    marked = F.size(F.filter(lines, lambda x: x.rlike(r"^(Art\.?|Artikel|§|\d+(\.\d+)*\.?\s)")))
    return (n >= 4) & (short > n * 0.7) & (marked > n * 0.4)


def fold_name(name: Column) -> Column:
    """Lower case, composed umlauts folded, other signs to _."""
    for letter, pair in (("a", "ä"), ("o", "ö"), ("u", "ü")):
        name = F.replace(name, F.lit(f"{letter}̈"), F.lit(pair))
    name = F.lower(name)
    for letter, pair in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        name = F.replace(name, F.lit(letter), F.lit(pair))
    return F.regexp_replace(name, "[^a-z0-9]+", "_")


KEYS_SENT = 100_000


def match_longest_key(df: DataFrame, name: str, id_: str, keys: DataFrame) -> DataFrame:
    """Adds the longest key (of equals the first) contained in the folded name; null if none is.

    Up to KEYS_SENT keys come to the driver and go to all tasks as one automaton, which reads a name once; of more, the
    parts of a name that are as long as some key are joined with the keys.
    """
    text, place = fresh(df, "_f"), fresh(df, "_n")
    folded = df.withColumn(text, fold_name(F.col(name)))
    keys = keys.select("key").where("key is not null").distinct()
    sent = [r["key"] for r in keys.limit(KEYS_SENT + 1).collect()]
    if len(sent) <= KEYS_SENT:
        longest_first = sorted(sent, key=lambda k: (-len(k), k))
        return folded.withColumn("key", scanned(F.col(text), longest_first, lambda met: longest_first[min(met)] if met else None, "string")).drop(text)
    sizes = [r[0] for r in keys.select(F.length("key")).distinct().collect()]  # as many as key lengths
    cuts = F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n))).otherwise(F.array().cast("array<string>"))))
    parts = folded.select(id_, F.explode(F.array_distinct(cuts)).alias("key")).join(keys, "key")
    order = W.partitionBy(id_).orderBy(F.desc(F.length("key")), "key")
    return folded.join(parts, id_, "left").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place, text)


#: Marks of articles at the beginning of a line. (?d): only a line feed ends a line; (?U): as letters and blanks of any script.
ARTICLE = {
    "federal": r"(?:Art\.|Artikel)\s+(\d+[a-z]?(?:bis|ter|quater|quinquies|sexies)?)\b",
    "cantonal": r"(?:§|Art\.|Artikel)\s*(\d+[a-z]?(?:bis|ter|quater)?)\b",
}


def split_articles(df: DataFrame, text: str, style: str = "federal") -> DataFrame:
    """A row for each article: article_no, body, part_no (columns of these names are replaced); what stands before the first is the preamble if it is over
    200 characters. A text without articles is one preamble.
    """
    mark = rf"(?mdU)^[^\S\n]*{ARTICLE[style]}"
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?mdU)(?=^[^\S\n]*{ARTICLE[style]})")
    rest = [c for c in df.columns if c not in ("part_no", "article_no", "body")]
    raw, count = fresh(df, "_body"), fresh(df, "_parts")
    rows = df.select(*rest, F.posexplode(parts).alias("part_no", raw), F.size(parts).alias(count))
    number = F.regexp_extract(raw, rf"\A{mark}", 1)
    body = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    rows = rows.withColumn("article_no", F.when(number != "", number).otherwise("preamble")).withColumn("body", body)
    return rows.where((F.col("article_no") != "preamble") | (F.col(count) == 1) | (F.length("body") > 200)).drop(raw, count)


def statute_documents(articles: DataFrame, url: str, name: str, style: str = "federal", publisher: str = "") -> DataFrame:
    """A document an article: source_url, source_name, title, tags, article_number.

    federal: `name` holds the law's abbreviation; cantonal: its number.
    """
    preamble = F.col("article_no") == "preamble"
    if style == "federal":
        kind, label, law, tags = "art", F.lit(" Art. "), F.col(name), F.array(F.lower(name))
    else:
        kind, label, law, tags = "para", F.lit(" § "), F.concat(F.lit("LS "), F.col(name)), F.array(F.lit("cantonal"), F.get(F.split(name, r"\."), F.lit(0)))
    part = F.when(preamble, "preamble").otherwise(F.concat(F.lit(f"{kind}-"), F.col("article_no")))
    return articles.withColumns(
        {
            "source_url": F.concat(F.col(url), F.lit("#"), part),
            "source_name": F.concat(F.lit(f"{publisher} — " if publisher else ""), law),
            "title": F.when(preamble, F.concat(law, F.lit(" — Präambel"))).otherwise(F.concat(law, label, F.col("article_no"))),
            "tags": tags,
            "article_number": F.when(~preamble, F.col("article_no")),
        }
    )


def enrich_district(df: DataFrame, code: str, lookup: DataFrame) -> DataFrame:
    """lookup: (code, district), twelve rows or so. Adds district and the tag kreis-N."""
    return df.join(lookup, code, "left").withColumn("district_tag", F.when(F.col("district").isNotNull(), F.concat(F.lit("kreis-"), F.col(code))))


def ingest_summary(chunks: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Documents, chunks, documents that are procedures and articles, and pages left out (`skipped`: category, source), for
    each category and source, each category, and all. What is counted thrice by the totals is a row a document, not its chunks.
    """
    kind = lambda name: F.max(F.when(F.col("doc_type") == name, F.col("doc_id")))
    rows = chunks.groupBy("category", "source", "doc_id").agg(F.count("*").alias("n"), kind("procedure").alias("_p"), kind("article").alias("_a")).withColumn("_s", F.lit(0).cast("long"))
    if skipped is not None:
        none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("doc_id", "_p", "_a")}
        left_out = skipped.groupBy("category", "source").agg(F.count("*").alias("_s"))
        rows = rows.unionByName(left_out.withColumns(none | {"n": F.lit(0).cast("long")}))
    return rows.rollup("category", "source").agg(
        F.count_distinct("doc_id").alias("docs_written"),
        F.sum("n").alias("total_chunks"),
        F.count_distinct("_p").alias("procedures"),
        F.count_distinct("_a").alias("articles"),
        F.sum("_s").alias("skipped"),
    )
