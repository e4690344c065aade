"""Queries of URL work, pages, chunking, audit and maintenance over `pages` and `documents`."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, chunks, ingest, pages, similar, urls
from ..sources import files
from .registry import query, table

PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda x: x <> '')"
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
RULES = urls.UrlRules(prefixes=("https://",), skip_prefixes=("https://m.",), skip_parts=("utm_source",), skip_extensions=(".pdf", ".html"), min_depth=1, max_depth=3)
ROUTES = [("/en/", "politics"), ("/fr/", "culture"), ("/de/", "admin"), ("/it/", None)]

#: One chunk a document, in the shape that the audit jobs take, with rows for each branch of their rules. The same in SQL below.
CHUNKS = """
select cast(doc_id as string) as chunk_id, cast(floor(doc_id / 3) as string) as doc_id, case when doc_id % 43 = 0 then 'P01' else cast(doc_id % 3 as string) end as chunk_index,
  case when doc_id % 53 = 0 then null else concat(case when doc_id % 11 = 0 then 'ftp://' else 'https://' end, source, '.ch/', lang, case when doc_id % 10 = 3 then '/p?language=fr' when doc_id % 10 = 4 then '/p?x=1&lang=fr'
    when doc_id % 10 = 5 then '/lang/it/p' when doc_id % 10 = 6 then '/lang/rm' else '/p' end, doc_id) end as source_url,
  source, case when doc_id % 47 = 0 then 'german' else lang end as language, case when doc_id % 29 = 0 then 'culture' when doc_id % 5 = 0 then 'law' when doc_id % 5 = 1 then 'admin' else 'food_drink' end as category,
  case when doc_id % 41 = 0 then null when doc_id % 4 = 0 then 'statute' when doc_id % 4 = 1 then 'procedure' when doc_id % 4 = 2 then 'article' else 'historical' end as doc_type,
  case when doc_id % 13 = 0 then ' ' when doc_id % 59 = 0 then null else substring(text, 1, 12) end as heading_path, case when doc_id % 23 = 0 then 'official' when doc_id % 2 = 0 then 'wikipedia' else 'private' end as authority,
  case when doc_id % 37 = 0 then 'poem' else 'prose' end as chunk_shape,
  case when doc_id % 17 = 0 then 'Admin/Umzug' when doc_id % 31 = 0 then 'admin' when doc_id % 61 = 0 then 'a/b/c' when doc_id % 3 = 0 then null else 'food_drink/x_1' end as subcategory,
  case when doc_id % 7 = 0 then lower(text) when doc_id % 7 = 1 then concat('  ', lower(text)) else text end as display_text,
  case when doc_id % 19 = 0 then 'other' when doc_id % 19 = 1 then concat('x ', substring(text, 1, 12), ' ', text) when doc_id % 19 = 2 then null else concat(' ', substring(text, 1, 12), ' ', text) end as embed_text, length(text) as n
from docs
"""
CHUNKS_SQL = CHUNKS.replace("as string", "as varchar").replace("from docs", "from documents").replace("floor(doc_id / 3)", "doc_id // 3")
TOKENS_SQL = "case when trim(regexp_replace({t}, '\\s+', ' ', 'g')) = '' or {t} is null then 0 else greatest(1, cast(floor(len(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')) * 1.3) as int)) end"
#: heading, display and embed text as the audit reads them: null as empty, blanks in front left out.
FLAGS_SQL = f"""
select *, not regexp_matches(h, '\\S') as f1, not coalesce(regexp_matches(source_url, '^https?://'), false) as f2,
  coalesce(try_cast(chunk_index as int), 0) > 0 and doc_type is distinct from 'statute' and regexp_matches(d, '^[a-zäöüß]{{3}}') as f3,
  h <> '' and starts_with(d, h) as f4, h <> '' and not starts_with(e, h) as f5
from (select *, coalesce(heading_path, '') as h, regexp_replace(coalesce(display_text, ''), '^\\s+', '') as d, regexp_replace(coalesce(embed_text, ''), '^\\s+', '') as e from ({CHUNKS_SQL}))
"""
FAILS_SQL = " union all ".join(f"select category, source, chunk_id, '{name}' as \"check\" from ({FLAGS_SQL}) where f{i}" for i, name in enumerate(audit.CHECKS, 1))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CHUNKS.replace("from docs", "from {docs}"), docs=table(spark, sf_dir, "documents"))
    return rows.withColumn("token_count", chunks.count_tokens(F.col("display_text")))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(f"""select page_id from pages where starts_with(url, 'https://') and not starts_with(url, 'https://m.') and not contains(url, 'utm_source')
and not ends_with(lower({PATH}), '.pdf') and not ends_with(lower({PATH}), '.html') and len({SEGMENTS}) between 1 and 3""")
def url_allow_deny(spark, sf_dir):
    return urls.url_filter(pages_of(spark, sf_dir), "url", RULES).select("page_id")


@query(f"""select * from (select page_id, case when starts_with({PATH}, '/en/') then 'politics' when starts_with({PATH}, '/fr/') then 'culture'
when starts_with({PATH}, '/de/') then 'admin' when starts_with({PATH}, '/it/') then null else 'other' end as category from pages) where category is not null""")
def route_category(spark, sf_dir):
    return urls.route_category(pages_of(spark, sf_dir), "url", ROUTES, "other").select("page_id", "category")


@query(f"select * from (select page_id, case {SEGMENTS}[1] when 'en' then 'civic' when 'de' then 'admin' when 'it' then null else 'leisure' end as category from pages) where category is not null")
def route_first_segment(spark, sf_dir):
    return urls.route_by_segment(pages_of(spark, sf_dir), "url", {"en": "civic", "de": "admin", "it": None}, "leisure").select("page_id", "category")


@query(f"""select page_id, case when length(leaf) > 0 then 'admin/' || lower(leaf) end as subcategory from (select page_id,
substr(regexp_replace(regexp_replace(regexp_replace({SEGMENTS}[-1], '\\.html$', ''), '-', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), 1, 40) as leaf from pages)""")
def derive_subcategory(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", urls.derive_subcategory(F.lit("admin"), F.col("url"), -1).alias("subcategory"))


@query("""select page_id, case when contains(url, 'blog') then 'blog' when contains(url, '//m.') then 'mobile' else 'general' end as label from pages""")
def route_subcategory_keywords(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", urls.first_keyword_label(F.col("url"), [("blog", "blog"), ("//m.", "mobile")], "general").alias("label"))


@query(f"select host, page_id from (select {HOST} as host, page_id, row_number() over (partition by {HOST} order by page_id) as n from pages) where n = 1")
def dedupe_urls_first_source(spark, sf_dir):
    rows = pages_of(spark, sf_dir).select(urls.host(F.col("url")).alias("host"), "page_id")
    return urls.dedupe_first(rows, ["host"], [F.col("page_id")])


@query("select doc_id, lang from documents order by case lang when 'es' then 0 when 'de' then 1 else 2 end, doc_id limit 25")
def priority_limit(spark, sf_dir):
    rank = F.when(F.col("lang") == "es", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return urls.priority_limit(table(spark, sf_dir, "documents").select("doc_id", "lang"), [rank, F.col("doc_id")], 25)


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) n from documents) where n <= 5")
def cap_per_source(spark, sf_dir):
    return urls.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], 5, [F.col("doc_id")])


@query("""select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by lang, source order by doc_id) n,
greatest(1, floor(count(*) over (partition by lang) * 0.05)) most from documents) where n <= most""")
def cap_group_share(spark, sf_dir):
    return urls.cap_share(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", 0.05, ["doc_id"])


@query("select lang, count(*) as n from documents group by lang")
def count_by_category(spark, sf_dir):
    return urls.count_by(table(spark, sf_dir, "documents"), "lang")


@query("""select host, href, year from (select host, href, year, row_number() over (partition by host order by year desc, href) n from (select
regexp_extract(url, '^https?://([^/?#]+)', 1) as host, url as href, coalesce(try_cast(regexp_extract(url, '((?:19|20)\\d{2})', 1) as int), 0) as year from pages)) where n = 1""")
def latest_edition(spark, sf_dir):
    return urls.latest_edition(pages_of(spark, sf_dir).select(urls.host(F.col("url")).alias("host"), F.col("url").alias("href")), "host", "href")


#: A quoted or bare href of an <a>, in the words of the other engine; its quotes and entities are taken off afterwards.
LINK_LIST_SQL = """list_transform(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), lambda x: replace(regexp_replace(x, '^["'']|["'']$', '', 'g'), '&amp;', '&'))"""
LINKS_SQL = f"""select distinct src, dst from (select src, regexp_replace(regexp_replace(case when regexp_matches(link, '^https?://') then link
when starts_with(link, '/') and not starts_with(link, '//') then 'https://' || regexp_extract(src, '^https?://([^/?#]+)', 1) || link end, '#.*$', ''), '/+$', '') as dst
from (select url as src, unnest({LINK_LIST_SQL}) as link from pages)) where dst is not null"""


@query(LINKS_SQL)
def extract_links(spark, sf_dir):
    return urls.extract_links(pages_of(spark, sf_dir), "url", "html")


#: Links in the order of a page's menu: from each to the next. Failed: targets of three characters.
MENU_SQL = f"select unnest(l[:-2]) as src, unnest(l[2:]) as dst from (select {LINK_LIST_SQL} as l from pages) where len(l) > 1"


@query(f"""with recursive e as (select distinct src, dst from ({MENU_SQL})), s as (select min(src) as node from e where length(src) <> 3),
r as (select node, 0 as depth from s union select e.dst, r.depth + 1 from r join e on r.node = e.src where r.depth < 4 and length(e.dst) <> 3)
select node, depth from (select node, min(depth) as depth from r group by node) order by depth, node limit 60""")
def crawl_reachability(spark, sf_dir):
    """What the first target reaches over the links that follow each other on pages."""
    menus = pages_of(spark, sf_dir).select(urls.hrefs(F.col("html")).alias("l")).where("size(l) > 1")
    steps = F.arrays_zip(F.slice("l", 1, F.size("l") - 1).alias("src"), F.slice("l", F.lit(2), F.size("l")).alias("dst"))
    edges = menus.select(F.explode(steps).alias("e")).select("e.src", "e.dst")
    failed = edges.select(F.col("dst").alias("node")).where("length(node) = 3")
    return urls.bfs_reach(edges, edges.where("length(src) <> 3").agg(F.min("src").alias("node")), 4, failed, 60)


FOREIGN_SQL = "contains(lower({url}), '/fr/') or contains(lower({url}), '/it/') or contains(lower({url}), '/en/') or contains(lower({url}), '/rm/') or regexp_matches(lower({url}), '/lang/(fr|it|en)/') or regexp_matches(lower({url}), '[?]lang(uage)?=(fr|it|en|rm)')"


@query(f"select page_id, {FOREIGN_SQL.format(url='u')} as foreign_language from (select page_id, url || case page_id % 6 when 0 then '?language=fr' when 1 then '&lang=fr' when 2 then '/lang/rm' when 3 then '/lang/it/' else '' end as u from pages)")
def flag_non_german(spark, sf_dir):
    more = F.expr("concat(url, case page_id % 6 when 0 then '?language=fr' when 1 then '&lang=fr' when 2 then '/lang/rm' when 3 then '/lang/it/' else '' end)")
    return pages_of(spark, sf_dir).select("page_id", urls.is_foreign_language_url(more).alias("foreign_language"))


@query("select distinct url || case when page_id % 5 = 0 then '?a<b' else '' end as loc, page_id % 7 = 0 as is_index from pages")
def sitemap_urls(spark, sf_dir):
    url = F.expr("replace(replace(concat(url, case when page_id % 5 = 0 then '?a<b' else '' end), '&', '&amp;'), '<', '&lt;')")
    kind = F.when(F.col("page_id") % 7 == 0, "sitemapindex").otherwise("urlset")
    landed = pages_of(spark, sf_dir).select(F.concat(F.lit("<"), kind, F.lit("><url>\n<loc> "), url, F.lit(" </loc></url></"), kind, F.lit(">")).alias("xml"))
    return urls.sitemap_urls(landed, "xml").distinct()


@query()
def extract_sections(spark, sf_dir):
    found = pages.extract_sections(pages_of(spark, sf_dir), "html")
    return found.select("page_id", "title", F.size("sections").alias("n_sections"), F.length("full_text").alias("n_chars"))


@query()
def normalise_html(spark, sf_dir):
    profile = pages.HtmlProfile(drop=frozenset({"ad"}), rename={"article": "main"}, title_suffix=".", bogus=frozenset({"navigation"}), title_from="og")
    found = pages.extract_sections(pages_of(spark, sf_dir), "html", profile)
    return found.select("page_id", "title", F.size("sections").alias("n_sections"), "full_text")


@query("select page_id from pages where contains(substr(html, 1, 20000), 'Error 404') = false")
def soft_404_filter(spark, sf_dir):
    return pages_of(spark, sf_dir).where(~pages.soft_404(F.col("html"))).select("page_id")


@query("select doc_id from documents where source <> '' and length(text) >= 300")
def min_text_filter(spark, sf_dir):
    return pages.min_text(table(spark, sf_dir, "documents"), "source", "text", 300).select("doc_id")


PLACE_SQL = "text || case doc_id % 4 when 0 then ' 8004 Zürich' when 1 then ' 18004' when 2 then ' 8004x' else '\n8001' end"


@query(f"select doc_id from (select doc_id, {PLACE_SQL} as t from documents) where regexp_matches(t, '\\b8\\d{{3}}\\b')")
def postcode_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(PLACE_SQL).alias("text"))
    return pages.region_filter(rows, "text").select("doc_id")


@query("select doc_id, case when length(string_split(text, chr(10))[1]) >= 200 then string_split(text, chr(10))[1] else text end as body from documents")
def reference_text_fallback(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.reference_body(F.get(F.split("text", "\n"), F.lit(0)), F.col("text")).alias("body"))


@query("""select doc_id, case when regexp_matches(split_part(text, '.', 1), '(?i)(schritt|etappe|step|étape|fase)\\s*\\d') or regexp_matches(text, '(?m)^\\s*\\d+[.)]\\s')
then 'procedure' else 'article' end as doc_type from documents""")
def classify_doc_type(spark, sf_dir):
    heading = F.array(F.get(F.split("text", r"\."), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", pages.classify_doc_type(heading, F.col("text")).alias("doc_type"))


KEYWORDS = ["schule", "the", "ment", "ción", "ung", "dé"]
SEEN_SQL = "lower(' ' || source || ' ' || substr(text, 1, 500) || ' ')"


@query(f"""select doc_id, array_to_string(list_filter({KEYWORDS}, lambda k: contains({SEEN_SQL}, k)), ',') as plain,
array_to_string(list_filter({KEYWORDS}, lambda k: contains({SEEN_SQL}, ' ' || k || ' ') or contains({SEEN_SQL}, k || 'en ')), ',') as words,
array_to_string(list_sort(list_distinct(list_append(list_transform(list_filter(['über', 'no más', 'für', 'au'], lambda k: contains({SEEN_SQL}, k)), lambda k: replace(replace(k, 'ü', 'ue'), ' ', '_')), 'kreis_' || doc_id % 12))), ',') as fixed from documents""")
def tag_keywords(spark, sf_dir):
    tags = lambda *a, **k: F.array_join(pages.tag_keywords(F.col("source"), F.col("text"), *a, **k), ",")
    fixed = F.array(F.concat(F.lit("kreis_"), F.col("doc_id") % 12))
    return table(spark, sf_dir, "documents").select(
        "doc_id", tags(KEYWORDS).alias("plain"), tags(KEYWORDS, mode="word", suffix="en").alias("words"), tags(["über", "no más", "für", "au"], fold=True, ordered=True, fixed=fixed).alias("fixed")
    )


@query("select doc_id, case when contains(substr(text, 1, 800), 'heit') then '18th' when contains(substr(text, 1, 800), 'tion') then '19th' end as period from documents")
def detect_period(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", urls.first_keyword_label(F.substring("text", 1, 800), [("heit", "18th"), ("tion", "19th")], None).alias("period"))


@query("""select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10) || chr(10)) as text
from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x)), lambda x: x <> '') as l from documents)""")
def dedupe_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.dedupe_paragraphs(F.col("text")).alias("text"))


@query("""select doc_id, case when p > 0 then p - 1 else n end as n_sections from (select doc_id, len(l) as n, list_position(list_transform(l, lambda x: lower(split_part(x, ' ', 1)) in ('the', 'die', 'la', 'le')), true) as p
from (select doc_id, string_split(text, chr(10)) as l from documents))""")
def drop_tail_sections(spark, sf_dir):
    parts = F.transform(F.split("text", "\n"), lambda x: F.struct(F.get(F.split(x, " "), F.lit(0)).alias("heading"), x.alias("text"), F.lit(2).alias("level")))
    kept = pages.drop_tail_sections(parts, ["the", "die", "la", "le"])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("n_sections"))


INDEX_SQL = """(select n >= 4 and short > n * 0.7 and marked > n * 0.4 from (select len(l) as n, len(list_filter(l, lambda x: len(regexp_split_to_array(x, '\\s+')) < 6)) as short,
len(list_filter(l, lambda x: regexp_matches(x, '^(Art\\.?|Artikel|§|\\d+(\\.\\d+)*\\.?\\s)'))) as marked from (select list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l)))"""
#: Runs of line breaks are set aside as one sign, single ones become blanks.
CLEAN_SQL = "trim(replace(replace(regexp_replace(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '\\n{2,}', chr(30), 'g'), chr(10), ' '), chr(30), chr(10) || chr(10)))"


@query(f"""select doc, sha1(string_agg(t, chr(10) || chr(10) order by doc_id)) as text_sha1 from (select doc_id // 8 as doc, doc_id, {CLEAN_SQL} as t from documents) where not {INDEX_SQL.format(t='t')} group by doc""")
def clean_pdf_text(spark, sf_dir):
    """Eight documents in a row as the pages of one: groups keep their size on tables of any size."""
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("doc"), F.col("doc_id").alias("page_no"), pages.clean_page_text(F.col("text")).alias("text"))
    return pages.join_pages(rows, "doc", "page_no", "text").select("doc", F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


@query(f"select doc_id, {INDEX_SQL.format(t='text')} as is_index from documents")
def drop_index_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.is_index_page(F.col("text")).alias("is_index"))


@query("""select s_suppkey, key from (select s_suppkey, key, row_number() over (partition by s_suppkey order by length(key) desc nulls last, key) n from
(select s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') as f from supplier) left join (values ('supplier'), ('supplier_00'), ('0001'), ('supplier_000000')) k(key) on contains(f, key)) where n = 1""")
def match_law_metadata(spark, sf_dir):
    keys = spark.createDataFrame([("supplier",), ("supplier_00",), ("0001",), ("supplier_000000",)], "key string")
    return pages.match_longest_key(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", "s_suppkey", keys).select("s_suppkey", "key")


#: Documents as laws: article marks of every kind before the lines, the first line bare.
MARKED = """case when i = 1 then x when i % 6 = 0 then concat('  Art. ', i, 'bis ', x) when i % 6 = 1 then concat('Artikel ', i, 'a ', x) when i % 6 = 2 then concat('Art. ', i, 'quinquies ', x)
when i % 6 = 3 then concat('Art. ', i, 'xy ', x) when i % 6 = 4 then concat('Art.', i, ' ', x) else concat('§ ', i, ' ', x) end"""
MARKED_SQL = f"select doc_id, i, m, {MARKED} as x from (select doc_id, unnest(l) as x, unnest(range(1, len(l) + 1)) as i, len(l) as m from (select doc_id, string_split(text, chr(10)) as l from documents))"
#: Lines that begin an article, by style, and its number.
NUMBERS = {"federal": "case when i = 1 then null when i % 6 = 0 then i || 'bis' when i % 6 = 1 then i || 'a' when i % 6 = 2 then i || 'quinquies' end", "cantonal": "case when i = 1 then null when i % 6 = 0 then i || 'bis' when i % 6 = 1 then i || 'a' when i % 6 in (4, 5) then cast(i as varchar) end"}


def articles_sql(style: str) -> str:
    """Articles as runs of lines that begin with a marked one; the run before the first is the preamble."""
    runs = f"select *, count(no) over (partition by doc_id order by i) as part from (select *, {NUMBERS[style]} as no from ({MARKED_SQL}))"
    rows = f"select doc_id, part, max(no) as no, max(part) over (partition by doc_id) as parts, regexp_replace(string_agg(x, chr(10) order by i), '^\\s+|\\s+$', '', 'g') as body from ({runs}) group by doc_id, part"
    return f"select doc_id, coalesce(no, 'preamble') as article_no, body from ({rows}) where no is not null or parts = 0 or length(body) > 200"


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.expr(f"zip_with(split(text, '\\n'), sequence(1, size(split(text, '\\n'))), (x, i) -> {MARKED})")
    whole = table(spark, sf_dir, "documents").select("doc_id", "source", F.array_join(marked, "\n").alias("text"))
    return whole.select("doc_id", "text", F.concat(F.lit("local://"), "source").alias("url"), F.upper("source").alias("abbrev"), F.concat(F.col("doc_id") % 900, F.lit(".1")).alias("ls_number"))


@query(f"select 'federal' as style, doc_id, article_no, sha1(body) as body_sha1 from ({articles_sql('federal')}) union all select 'cantonal', doc_id, article_no, sha1(body) from ({articles_sql('cantonal')})")
def split_statute_articles(spark, sf_dir):
    rows = statutes(spark, sf_dir)
    found = [pages.split_articles(rows, "text", style).select(F.lit(style).alias("style"), "doc_id", "article_no", F.sha1(F.col("body").cast("binary")).alias("body_sha1")) for style in ("federal", "cantonal")]
    return found[0].unionByName(found[1])


#: As CLEAN_SQL; a line break before an article's mark is set aside too.
CLEAN_MARKED_SQL = "trim(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '\\n{2,}', chr(30), 'g'), '\\n(§|Art\\.)', chr(29) || '\\1', 'g'), chr(10), ' '), chr(29), chr(10)), chr(30), chr(10) || chr(10)))"


@query(f"select doc_id, sha1({CLEAN_MARKED_SQL}) as text_sha1 from (select doc_id, string_agg(x, chr(10) order by i) as text from ({MARKED_SQL}) group by doc_id)")
def clean_marked_text(spark, sf_dir):
    """Statute texts, whose lines stay apart before marks."""
    return statutes(spark, sf_dir).select("doc_id", F.sha1(pages.clean_page_text(F.col("text"), markers=True).cast("binary")).alias("text_sha1"))


@query(f"""select doc_id, 'local://' || source || '#' || case when article_no = 'preamble' then article_no else 'art-' || article_no end as source_url, 'P — ' || upper(source) as source_name,
upper(source) || case when article_no = 'preamble' then ' — Präambel' else ' Art. ' || article_no end as title, source as tags, nullif(article_no, 'preamble') as article_number, length(body) as n_chars from ({articles_sql('federal')}) join documents using (doc_id)
union all select doc_id, 'local://' || source || '#' || case when article_no = 'preamble' then article_no else 'para-' || article_no end, 'LS ' || doc_id % 900 || '.1',
'LS ' || doc_id % 900 || '.1' || case when article_no = 'preamble' then ' — Präambel' else ' § ' || article_no end, 'cantonal,' || doc_id % 900, nullif(article_no, 'preamble'), length(body) from ({articles_sql('cantonal')}) join documents using (doc_id)""")
def build_statute_docs(spark, sf_dir):
    rows = statutes(spark, sf_dir)
    found = [
        pages.statute_documents(pages.split_articles(rows, "text", style), "url", name, style, publisher).select("doc_id", "source_url", "source_name", "title", F.array_join("tags", ",").alias("tags"), "article_number", F.length("body").alias("n_chars"))
        for style, name, publisher in (("federal", "abbrev", "P"), ("cantonal", "ls_number", ""))
    ]
    return found[0].unionByName(found[1])


@query("""select s_suppkey, n_name as district, case when n_name is not null then 'kreis-' || s_nationkey end as district_tag from supplier left join nation on n_nationkey = s_nationkey and n_regionkey < 3""")
def district_enrich(spark, sf_dir):
    lookup = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("district"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("code"))
    return pages.enrich_district(rows, "code", lookup).select("s_suppkey", "district", "district_tag")


@query(f"""select category, source, count(distinct doc_id) as docs_written, count(doc_id) as total_chunks, count(distinct doc_id) filter (where doc_type = 'procedure') as procedures,
count(distinct doc_id) filter (where doc_type = 'article') as articles, count(*) filter (where doc_id is null) as skipped
from (select category, source, doc_id, doc_type from ({CHUNKS_SQL}) union all select 'law', source, null, null from documents where doc_id % 7 = 0) group by rollup (category, source)""")
def ingest_summary(spark, sf_dir):
    skipped = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.lit("law").alias("category"), "source")
    return pages.ingest_summary(chunk_rows(spark, sf_dir), skipped)


#: Documents as pages of two sources: marked up, a line a paragraph, under a menu; some of them not the source's.
PAGE = """concat('<head><title>x | Site</title></head><body><nav><p>menu</p></nav><main><h1> ', source, ' ', doc_id, '</h1><h2>', case when doc_id % 6 = 0 then 'Schritt 2' else 'Teil' end, '</h2><p>',
replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p>\n<p>'), '</p><h2>Links</h2><p>more</main>')"""
PAGE_URL = "concat('https://x.ch/', case when doc_id % 10 = 9 then 'old/' else '' end, doc_id)"
PAGE_TEXT_SQL = "(select array_to_string(list_filter(l, lambda x, i: x <> '' and list_position(l, x) = i), chr(10) || chr(10)) from (select list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) as l))"


def city_source(category: str, slug: str) -> ingest.Source:
    return ingest.Source(
        category, slug, slug.upper(), "city", "de", datetime.date(2025, 6, 1), 30, link_filter=lambda url: ~url.contains("/old/"), title_transform=lambda title, url: F.concat(title, F.lit(" - "), F.regexp_extract(url, "[0-9]+$", 0)),
        tags_for=lambda title, text: pages.tag_keywords(title, text, KEYWORDS, head=1_000_000), subcategory_for=lambda url: urls.derive_subcategory(F.lit(category), url, -1), tail=("links",),
    )


@query(f"""with p as (select case when doc_id % 2 = 0 then 'admin' else 'law' end as category, case when doc_id % 2 = 0 then 'even' else 'odd' end as source, doc_id, {PAGE_TEXT_SQL} as t from documents where doc_id % 10 <> 9),
k as (select *, length(t) >= 300 as good, doc_id % 6 = 0 or regexp_matches(t, '(?m)^\\s*\\d+[.)]\\s') as steps from p)
select category, source, count(*) filter (where good) as docs_written, count(*) filter (where good and steps) as procedures, count(*) filter (where good and not steps) as articles, count(*) filter (where not good) as skipped from k group by rollup (category, source)""")
def ingest_job(spark, sf_dir):
    """Two sources' pages to chunks, written by category and source; what was written and what was left out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(PAGE_URL).alias("url"), F.expr(PAGE).alias("html"))
    urls.keep_checkpoints(spark)
    chunked, left_out = zip(*[ingest.ingest(rows.where(test), city_source(*at)) for test, at in (("doc_id % 2 = 0", ("admin", "even")), ("doc_id % 2 = 1", ("law", "odd")))])
    at = f"{urls.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    files.write_chunks(chunked[0].unionByName(chunked[1]).checkpoint(), at)
    summary = pages.ingest_summary(files.read_chunks(spark, at), left_out[0].unionByName(left_out[1]))
    return summary.drop("total_chunks")


@query(f"select doc_id, {TOKENS_SQL.format(t='text')} as tokens from documents")
def count_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunks.count_tokens(F.col("text")).alias("tokens"))


@query("""select doc_id, len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+([A-ZÄÖÜ])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda x: trim(x) <> '')) as sentences from documents""")
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunks.split_sentences(F.col("text"))).alias("sentences"))


@query()
def pack_sentences(spark, sf_dir):
    packed = chunks.pack_sentences(chunks.split_sentences(F.col("text")), F.lit(600))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(packed).alias("piece")).select("doc_id", chunks.count_tokens(F.col("piece")).alias("tokens"), F.sha1(F.col("piece").cast("binary")).alias("sha1"))


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, chunks.DOC_TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit("Part "), i).alias("heading"), x.alias("text"), F.lit(2).alias("level")))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://x.ch/"), "doc_id").alias("source_url"), F.col("source").alias("source_name"), F.substring("text", 1, 20).alias("title"), F.col("lang").alias("language"),
        F.lit("admin").alias("category"), F.lit("city").alias("authority"), kind.alias("doc_type"), F.lit(None).cast("string").alias("subcategory"), F.lit("2025-01-01").cast("date").alias("created_at"),
        F.lit("2025-06-01").cast("date").alias("updated_at"), F.when(F.col("doc_id") % 2 == 0, lines).alias("sections"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("text"),
    )


@query()
def chunk_documents(spark, sf_dir):
    found = chunks.chunk_documents(chunks.validate_documents(kb_documents(spark, sf_dir))[0])
    return found.select("chunk_id", "doc_id", "parent_chunk_id", "doc_type", "heading_path", "token_count", "step_index", "paragraph", F.sha1(F.col("display_text").cast("binary")).alias("text_sha1"))


@query("select doc_id, substr(sha1('https://x.ch/' || doc_id || '|' || lang || '|1'), 1, 12) as kb_id, substr(sha1('https://x.ch/' || doc_id || '|' || lang || '|1'), 1, 12) || '_' || lpad(cast(doc_id % 50 as varchar), 4, '0') as chunk_id from documents")
def assign_ids(spark, sf_dir):
    own = chunks.doc_id(F.concat(F.lit("https://x.ch/"), "doc_id"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("kb_id"), chunks.chunk_id(own, (F.col("doc_id") % 50).cast("string")).alias("chunk_id"))


@query("select doc_id, concat_ws(' > ', source, lang, case when doc_id % 3 > 0 then substr(text, 1, 10) end) as heading_path, concat_ws(' > ', source, lang, case when doc_id % 3 > 0 then substr(text, 1, 10) end) || chr(10) || chr(10) || text as embed_text from documents")
def heading_and_embed_text(spark, sf_dir):
    path = chunks.heading_path(F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 10)))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("heading_path"), chunks.embed_text(path, F.col("text")).alias("embed_text"))


@query(f"""select reasons, count(*) as n from (select concat_ws(',', case when coalesce(doc_type, '') not in ('article', 'procedure', 'reference', 'statute', 'historical') then 'doc_type' end,
case when authority not in ('federal', 'cantonal', 'city', 'wikipedia', 'community', 'private') then 'authority' end,
case when category not in ('admin', 'housing', 'mobility', 'health', 'emergency', 'education', 'civic', 'leisure', 'food_drink', 'neighborhoods', 'law') then 'category' end,
case when chunk_shape not in ('prose', 'table', 'list', 'code') then 'chunk_shape' end, case when subcategory is not null and not regexp_full_match(subcategory, '[a-z_]+/[a-z0-9_]+') then 'subcategory' end,
case when not regexp_full_match(language, '[a-z]{{2,3}}') then 'language' end, case when trim(coalesce(heading_path, '')) = '' then 'heading_path' end) as reasons from ({CHUNKS_SQL})) group by reasons""")
def validate_chunks(spark, sf_dir):
    good, bad = chunks.validate_chunks(chunk_rows(spark, sf_dir))
    reasons = bad.select(F.array_join("reasons", ",").alias("reasons")).unionByName(good.select(F.lit("").alias("reasons")))
    return reasons.groupBy("reasons").agg(F.count("*").alias("n"))


@query("select doc_id, true as ok from documents where length(text) > 0 and doc_id % 9 > 0")
def validate_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("array<struct<heading:string,text:string,level:int>>").alias("sections"), F.when(F.col("doc_id") % 9 > 0, F.lit("2025-01-01").cast("date")).alias("created_at"), F.lit("2025-01-02").cast("date").alias("updated_at"))
    return chunks.validate_documents(docs)[0].select("doc_id", F.lit(True).alias("ok"))


@query("""select '{"doc_id":' || doc_id || ',"lang":"' || lang || '","district":null}' as value from documents""")
def chunk_to_json(spark, sf_dir):
    return chunks.to_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(None).cast("string").alias("district")))


@query(f"""with f as ({FAILS_SQL}), t as (select category, source, count(*) as total from ({CHUNKS_SQL}) group by all), a as (select sum(total) as total from t)
select f.category, f.source, "check", count(*) as fails, any_value(t.total) as total, round(100 * count(*) / any_value(t.total), 2) as pct from f join t on f.category = t.category and f.source = t.source group by f.category, f.source, "check"
union all select null, null, "check", count(*), any_value(a.total), round(100 * count(*) / any_value(a.total), 2) from f, a group by "check" union all select null, null, null, count(*), any_value(a.total), round(100 * count(*) / any_value(a.total), 2) from f, a""")
def audit_fail_counts(spark, sf_dir):
    return audit.audit_summary(chunk_rows(spark, sf_dir))


@query(f'select chunk_id, array_to_string(list_filter([case when f1 then \'heading_path\' end, case when f2 then \'bad_url\' end, case when f3 then \'mid_word\' end, case when f4 then \'display_has_heading\' end, case when f5 then \'embed_lacks_heading\' end], lambda x: x is not null), \',\') as failed from ({FLAGS_SQL})')
def audit_flags(spark, sf_dir):
    return audit.audit_flags(chunk_rows(spark, sf_dir)).select("chunk_id", F.array_join("failed", ",").alias("failed"))


@query(f"""select category, source, count(*) as total_chunks, sum(cast(f1 as int) + cast(f2 as int) + cast(f3 as int) + cast(f4 as int) + cast(f5 as int)) as fails, count(*) filter (where f1) as n_heading_path,
count(*) filter (where f2) as n_bad_url, count(*) filter (where f3) as n_mid_word, count(*) filter (where f4) as n_display_has_heading, count(*) filter (where f5) as n_embed_lacks_heading
from ({FLAGS_SQL}) group by category, source having fails > 0 order by fails desc, category, source limit 15""")
def audit_top_offenders(spark, sf_dir):
    return audit.audit_top_offenders(chunk_rows(spark, sf_dir))


@query(f"""select bucket, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from (select case when t < 100 then '<100' when t < 400 then '100-399' when t <= 600 then '400-600' when t <= 1000 then '601-1000' else '>1000' end as bucket
from (select {TOKENS_SQL.format(t='display_text')} as t from ({CHUNKS_SQL}))) group by bucket""")
def audit_token_histogram(spark, sf_dir):
    return audit.token_histogram(chunk_rows(spark, sf_dir))


@query(f"""select chunk_id, "check" from (select *, row_number() over (partition by "check" order by chunk_id) n from ({FAILS_SQL} union all select category, source, chunk_id, 'oversize' from ({CHUNKS_SQL}) where {TOKENS_SQL.format(t='display_text')} > 1000))
where n <= case when "check" in ('mid_word', 'oversize') then 10 else 5 end""")
def audit_examples(spark, sf_dir):
    return audit.audit_examples(chunk_rows(spark, sf_dir))


@query(f"select source, count(*) as total, count(*) filter (where doc_type = 'statute') as statutes, count(*) filter (where doc_type = 'procedure') as procedures from ({CHUNKS_SQL}) group by source")
def audit_type_counts(spark, sf_dir):
    return audit.type_counts(chunk_rows(spark, sf_dir))


@query(f"select category, chunk_id from ({CHUNKS_SQL}) qualify row_number() over (partition by category order by md5(chunk_id || '|7'), chunk_id) <= 3")
def stratified_sample(spark, sf_dir):
    return audit.stratified_sample(chunk_rows(spark, sf_dir), "category", 3, "chunk_id", 7).select("category", "chunk_id")


def unwanted_section():
    return audit.is_unwanted_section(F.col("source_url"), F.col("source"), "src1", ["/p1"], ["/de/", "/es/"])


REASON_SQL = f"""case when {FOREIGN_SQL.format(url='source_url')} then 'foreign_language'
when source = 'src1' and not contains(source_url, '/p1') and (contains(source_url, '/de/') or contains(source_url, '/es/')) then 'unwanted_section' end"""


@query(f"select chunk_id, coalesce(source = 'src1' and not contains(source_url, '/p1') and (contains(source_url, '/de/') or contains(source_url, '/es/')), false) as unwanted from ({CHUNKS_SQL})")
def flag_unwanted_section(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("chunk_id", unwanted_section().alias("unwanted"))


@query(f"with r as (select {REASON_SQL} as reason from ({CHUNKS_SQL})) select coalesce(reason, 'remaining') as reason, count(*) as n from r group by 1 union all select 'total', count(*) from r")
def cleanup_report(spark, sf_dir):
    return audit.cleanup_report(chunk_rows(spark, sf_dir), unwanted_section())


@query(f"select chunk_id from ({CHUNKS_SQL}) where {REASON_SQL} is null")
def cleanup_apply(spark, sf_dir):
    return audit.cleanup_apply(chunk_rows(spark, sf_dir), unwanted_section()).select("chunk_id")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents: what is stored, and what a later crawl finds."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("updated_at"), "o_orderstatus", "o_orderpriority")
    stored = rows.where("o_orderstatus <> 'P'")
    crawled = rows.where("o_orderpriority <> '5-LOW'").withColumn("updated_at", F.expr("date_add(updated_at, cast(doc_id % 3 as int))"))
    return stored, crawled


@query("""with r as (select o_orderkey as doc_id, cast(o_orderdate as date) as d, o_orderstatus, o_orderpriority from orders), s as (select * from r where o_orderstatus <> 'P'), c as (select doc_id, d + cast(doc_id % 3 as int) as d from r where o_orderpriority <> '5-LOW')
select coalesce(s.doc_id, c.doc_id) as doc_id, case when s.doc_id is null then 'new' when c.doc_id is null then 'deleted' when c.d > s.d then 'changed' else 'unchanged' end as change from s full outer join c on s.doc_id = c.doc_id""")
def change_set(spark, sf_dir):
    return chunks.change_set(*versions(spark, sf_dir))


@query("""with l as (select l_orderkey as doc_id, l_linenumber as n, l_returnflag, 'old' as v from lineitem), new as (select doc_id, n, 'new' as v from l where l_returnflag = 'R')
select doc_id, n, v from l where doc_id not in (select doc_id from new) and doc_id not in (select o_orderkey from orders where o_orderpriority = '5-LOW') union all select * from new""")
def upsert_docs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), "l_returnflag")
    new = lines.where("l_returnflag = 'R'").select("doc_id", "n", F.lit("new").alias("v"))
    deleted = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("doc_id"))
    return chunks.upsert_docs(lines.select("doc_id", "n", F.lit("old").alias("v")), new, deleted)


@query("select o_orderkey as doc_id from orders where o_orderkey % 4 > 0 and cast(o_orderdate as date) + cast(o_orderkey % 900 as int) <= date '1997-01-01'")
def due_for_recrawl(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("updated_at"), F.expr("case when o_orderkey % 4 > 0 then cast(o_orderkey % 900 as int) end").alias("ttl_days"))
    return chunks.due_for_recrawl(rows, "1997-01-01").select("doc_id")


#: Every paragraph of every document: its number behind the document's.
PARAGRAPHS_SQL = "select doc_id * 100000 + i - 1 as id, list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: w <> '') as w from (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)"


@query(f"""with p as (select id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from ({PARAGRAPHS_SQL})),
c as (select s, min(id) as class from p group by s), t as (select class, len(s) as n, unnest(s) as t from c),
l as (select a.class, b.class as other from t a join t b on a.t = b.t and a.class <> b.class group by a.class, b.class, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*)))
select id, class, coalesce(k, 0) as links from p join c using (s) left join (select class, count(*) as k from l group by class) using (class)""")
def near_duplicates(spark, sf_dir):
    """Paragraphs by five-word shingles at 0.8."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return similar.near_duplicates(lines.select((F.col("doc_id") * 100_000 + F.col("i")).alias("id"), "x"), "id", "x")
