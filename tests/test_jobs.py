"""Jobs outside the llm subpackage: every query against its SQL at the smallest size, and the sequential helpers."""

import datetime
import hashlib
import math
import os
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cityjobs.operators import audit, chunks, evals, opendata, pages, retrieval, urls
from cityjobs.plans import answers, corpus, feeds, registry  # noqa: F401
from cityjobs.sources import files
from cityjobs.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "None"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(registry.ORACLES[name])
    there = [c[0] for c in found.description]
    assert names == sorted(there)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(plain(r[there.index(c)]) for c in names) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


TEXT = "Das ist ein Satz mit einigen Worten. Hier folgt der zweite Satz dazu! Kommt noch ein dritter Satz? "


def test_pack_rules():
    assert chunks.pack(["a", "b", "c"], [300, 300, 50], 600) == ["a b c"]
    assert chunks.pack(["a", "b", "c", "d"], [500, 70, 200, 400], 600) == ["a b", "b c", "d"]
    assert chunks.pack(["a", "big", "c"], [5, 900, 150], 600) == ["a", "big", "c"]
    assert chunks.pack([], [], 600) == []


def test_chunk_documents(spark):
    base = {"source_url": "https://example.ch/x", "source_name": "Example", "title": "Demo", "language": "de", "category": "admin", "authority": "federal", "subcategory": None, "created_at": datetime.date(2025, 1, 1), "updated_at": datetime.date(2025, 6, 1)}
    sec = lambda h, t: {"heading": h, "text": t, "level": 2}
    rows = [
        base | {"doc_type": "article", "sections": [sec("A", TEXT * 80), sec("", TEXT)], "text": None},
        base | {"source_url": "p", "doc_type": "procedure", "sections": [sec("Schritt 1", TEXT), sec("Schritt 2", "")], "text": None},
        base | {"source_url": "s", "doc_type": "statute", "sections": None, "text": "1 " + TEXT * 50 + "\n2 " + TEXT * 50},
        base | {"source_url": "r", "doc_type": "reference", "sections": [sec("a", "x"), sec("b", "y")], "text": None},
    ]
    schema = "source_url string, source_name string, title string, language string, category string, authority string, subcategory string, created_at date, updated_at date, doc_type string, sections array<struct<heading:string,text:string,level:int>>, text string"
    found = chunks.chunk_documents(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)).collect()
    by = lambda kind: [r for r in found if r["doc_type"] == kind]
    article = by("article")
    assert article[0]["chunk_index"] == "P01" and article[0]["chunk_id"].endswith("_P01")
    assert all(r["parent_chunk_id"] == article[0]["chunk_id"] for r in article[1:-1]) and article[-1]["parent_chunk_id"] is None
    assert [r["step_index"] for r in by("procedure")] == [1, 2]
    assert [r["paragraph"] for r in by("statute")] == ["2", "3"]
    assert [r["display_text"] for r in by("reference")] == ["x\ny"]
    assert len({r["chunk_id"] for r in found}) == len(found)


def test_extract_sections(spark):
    html = "<html><head><title>T</title></head><body><nav>no</nav><main><h1>Title</h1><p>Intro<h2>A</h2><p>One<p>One<ul><li>Two</ul><script>x</script><h3>Empty</h3></main><footer>f</footer></body>"
    row = pages.extract_sections(spark.createDataFrame([(html,), (None,)], "html string"), "html").first()
    assert row["title"] == "Title"
    assert [(s["heading"], s["text"], s["level"]) for s in row["sections"]] == [("", "Intro", 2), ("A", "One\n\nTwo", 2)]


def sections_of(spark, html, **options):
    row = pages.extract_sections(spark.createDataFrame([(html, "x")], "html string, title string"), "html", pages.HtmlProfile(**options)).first()
    return row["title"], [(x["heading"], x["text"], x["level"]) for x in row["sections"]], row["full_text"]


def test_extract_sections_rules(spark):
    page = '<head><title>Site | X</title><meta property="og:title" content="Og"></head><body><header><h1>In <b>head</b></h1><p>no</header><form><p>Before</p></form><h2>A</h2><p>one<b>two</b> three</p><ul><li><p>x</p> y</li></ul><aside><p>no</aside><h3>B</h3><p>1</p><p>1</p><h2>Empty</h2></body>'
    want = [("", "Before", 2), ("A", "one two three\n\nx y\n\nx", 2), ("B", "1", 3)]
    assert sections_of(spark, page) == ("In head", want, "Before\n\none two three\n\nx y\n\nx\n\n1")
    assert sections_of(spark, page, bogus=frozenset({"in head"}))[0] == "Og"
    assert sections_of(spark, page.replace("og:title", "no"), bogus=frozenset({"*"}), title_suffix=" | X")[0] == "Site"
    assert sections_of(spark, page, title_from="h2")[0] == "A"
    assert sections_of(spark, "<body>out<main>in<p></p></main><main><p>second</main>")[1:] == ([("", "in", 2)], "in")
    assert sections_of(spark, None) == sections_of(spark, "") == ("", [], "")
    assert sections_of(spark, "<div>a<div class='ad x'><h1>no</h1>b</div>c</div>", drop=frozenset({"ad"})) == ("", [("", "a\nc", 2)], "a\nc")
    assert sections_of(spark, "<x-h level='9'>H</x-h><x-h level='3'>I</x-h><p>t</p><x-a heading='F'>some <i>text</i></x-a>", levels="x-h", folds="x-a")[1] == [("I", "t", 3), ("F", "some text", 3)]
    two = "<div id='mainContent1'><p>a</div><div id='mainContent2'><p>longer</div><p>out"
    assert sections_of(spark, two, root=("div", "mainContent"))[2] == "a"
    assert sections_of(spark, two, root=("div", "mainContent"), largest=True)[2] == "longer"
    assert sections_of(spark, "<main><p>one<p>two<ul><li>a<li>b<ul><li>c</ul></ul>")[2] == "one\n\ntwo\n\na\n\nb c\n\nc"


def slow_pack(text, target, count):
    """The packing rules read one by one: sentences in turn, the next piece begins with what of the last fits an eighth."""
    out, piece = [], []
    for sentence in [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])", text.strip()) if x.strip()]:
        if count(sentence) > target:  # too long: on its own
            out += [piece, [sentence]] if piece else [[sentence]]
            piece = []
        elif piece and sum(map(count, piece)) + count(sentence) > target:
            out.append(piece)
            overlap = [piece[k:] for k in range(len(piece) + 1) if sum(map(count, piece[k:])) <= int(target * 0.125)][0]
            fits = sum(map(count, overlap)) + count(sentence) <= target
            piece = [*(overlap if fits else []), sentence]
        else:
            piece = [*piece, sentence]
    if piece and out and sum(map(count, piece)) < 100:  # too short: joined to the last
        out[-1] = out[-1] + piece
    elif piece:
        out.append(piece)
    return [" ".join(x) for x in out]


def slow_chunks(row, count=lambda t: max(1, int(len(t.split()) * 1.3)) if t.split() else 0):
    """A document's chunks as (index, parent, heading, text, step, paragraph), by the rules read one by one."""
    packed = lambda text, most: slow_pack(text, most, count)
    sections = [(x["heading"] or "", (x["text"] or "")[:80_000]) for x in row["sections"] or []]
    text, kind, above, rows = (row["text"] or "")[:80_000], row["doc_type"], {}, []
    if kind in ("article", "historical"):
        for heading, part in sections:
            if count(part) > 1200:
                key = heading or "body"
                above[key] = (above[key][0] if key in above else f"P{len(above) + 1:02d}", part)
        for heading, part in sections or [("", text)]:
            rows += [(above.get(heading or "body", (None,))[0], heading, x, None, None) for x in packed(part, 600 if kind == "article" else 400)]
    elif kind == "procedure" and sections:
        rows = [(None, heading, part, k, None) for k, (heading, part) in enumerate(sections, 1)]
    elif kind == "procedure":
        rows = [(None, "", text, None, None)] if count(text) <= 800 else [(None, "", x, k, None) for k, x in enumerate(packed(text, 600), 1)]
    else:
        whole = "\n".join(part for _, part in sections) if sections else text
        if kind == "statute" and count(whole) > 2000:
            rows = [(None, "", x.strip(), None, str(k)) for k, x in enumerate(re.split(r"(?m)(?=^\s*\d+\s)", whole), 1) if x.strip()]
        else:
            rows = [(None, "", whole, None, None)]
    return [(index, None, "" if key == "body" else key, part, None, None) for key, (index, part) in above.items()] + [(str(k), *x) for k, x in enumerate(rows)]


def test_chunks_of_all_documents_by_the_rules(spark):
    docs = chunks.validate_documents(corpus.kb_documents(spark, SF))[0]
    want = []
    for row in docs.collect():
        own = hashlib.sha1(f"{row['source_url']}|{row['language']}|1".encode()).hexdigest()[:12]
        name = lambda x, own=own: f"{own}_{x if x.startswith('P') else x.zfill(4)}"
        for index, parent, heading, text, step, paragraph in slow_chunks(row):
            path = " > ".join(x for x in (row["source_name"], row["title"], heading or None) if x is not None)
            want.append((name(index), name(parent) if parent else None, path, text, step, paragraph, chunks.words_count(text)))
    got = chunks.chunk_documents(docs).select("chunk_id", "parent_chunk_id", "heading_path", "display_text", "step_index", "paragraph", "token_count").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 300


def test_chunks_of_another_counter(spark):
    """A counter of letters by four, loaded once a task: every rule follows it."""
    count = lambda t: len(t) // 4
    docs = chunks.validate_documents(corpus.kb_documents(spark, SF))[0]
    want = [(row["source_url"], index, text, count(text)) for row in docs.collect() for index, _, _, text, _, _ in slow_chunks(row, count)]
    got = chunks.chunk_documents(docs, lambda: lambda texts: [len(t) // 4 for t in texts]).select("source_url", "chunk_index", "display_text", "token_count")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    texts = spark.createDataFrame([("abcdefgh",), (None,), (" ",), ("x",)], "t string")
    assert [r[0] for r in texts.select(chunks.count_tokens(F.col("t"), lambda: lambda texts: [len(t) // 4 for t in texts])).collect()] == [2, 0, 0, 0]


def test_numbered_parts_are_those_of_the_pattern():
    cases = ["", "1 a", "1 a\n2 b", "x\n\n \n 12 b\n13", "x\n12\n", "12\n", "\n\n3 a\n\n", "a\n4\tb\n5b\n 6 ", "x\n7\x0b8 ", "\n".join(f"{k} t" if k % 3 else "" for k in range(50))]
    for text in cases:
        assert chunks.numbered_parts(text) == re.split(r"(?m)(?=^\s*\d+\s)", text), repr(text)
    start = time.perf_counter()
    assert len(chunks.numbered_parts("\n" * 500_000 + "1 x")) == 500_002
    assert time.perf_counter() - start < 5


def test_packed_and_limited_rows_by_hand(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = []
    for doc_id, text in texts.items():
        count = lambda t: max(1, int(len(t.split()) * 1.3)) if t.split() else 0
        want += [(doc_id, count(x), hashlib.sha1(x.encode()).hexdigest()) for x in slow_pack(text, 600, count)]
    got = [(r["doc_id"], r["tokens"], r["sha1"]) for r in registry.QUERIES["pack_sentences"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    requests, log, accepted = sorted((str(r["user_id"]), r["ts"]) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).collect()), {}, []
    for key, at in requests:
        log[key] = [x for x in log.get(key, []) if (at - x).total_seconds() <= 6 * 3600]
        accepted.append((key, at, len(log[key]) < 2))
        if accepted[-1][2]:
            log[key].append(at)
    assert sorted(map(tuple, registry.QUERIES["rate_limit"](spark, SF).collect())) == accepted


def test_crime_rows_without_districts(spark):
    schema = "year int, district string, municipality string, title string, offences long, frequency double"
    rows = [(2024, None, "Z", "old", 9, 1.0), (2025, "", "ZÜRICH", "t", 3, 1.25), (2025, "Kreis 1", "Zürich", "t", 4, 2.0), (2025, "Kreis 11", "Zürich", "t", 5, 2.0)]
    got = lambda rows, *a: [(r["district"], r["offences"], r["frequency"]) for r in opendata.crime_stats(spark.createDataFrame(rows, schema), *a).collect()]
    assert got(rows) == [("Kreis 11", 5, 2.0), ("Kreis 1", 4, 2.0)]
    assert got(rows, "1") == got(rows, "Kreis 1") == [("Kreis 1", 4, 2.0)]
    assert got([*rows[:2], (2025, None, "Zürich", "t", 7, 1.0), (2025, "", "Bern", "t", 8, 1.0)]) == [("Gesamt", 3, 1.2)]
    with pytest.raises(ValueError):
        opendata.crime_stats(spark.createDataFrame(rows, schema), "13")


def test_chunk_rules(spark):
    good = {"doc_type": "article", "authority": "wikipedia", "category": "food_drink", "chunk_shape": "list", "subcategory": "admin/umzug_2", "language": "de", "heading_path": "a > b", "token_count": 0}
    bad = {"doc_type": [None, "page"], "authority": ["official", "other"], "category": ["culture", "transport"], "chunk_shape": ["poem"], "subcategory": ["Admin/Umzug", "admin", "a/b/c", "a1/b"], "language": ["german", "D"], "heading_path": ["", " \u00a0", None], "token_count": [-1, None]}
    rows = [tuple(good.values())] + [tuple((good | {k: v}).values()) for k, values in bad.items() for v in values]
    schema = "doc_type string, authority string, category string, chunk_shape string, subcategory string, language string, heading_path string, token_count int"
    ok, wrong = chunks.validate_chunks(spark.createDataFrame(rows, schema))
    assert ok.count() == 1
    assert sorted(r["reasons"][0] for r in wrong.collect()) == sorted(k for k, values in bad.items() for _ in values)
    assert all(len(r["reasons"]) == 1 for r in wrong.collect())


def test_chunks_replace_columns_of_their_names(spark):
    schema = "source_url string, source_name string, title string, language string, category string, authority string, doc_type string, heading_path string, token_count int, _p string, _d string, _parts int, created_at date, updated_at date, sections array<struct<heading:string,text:string,level:int>>, text string"
    day = datetime.date(2025, 1, 1)
    docs = spark.createDataFrame([("u", "s", "t", "de", "admin", "city", "article", "own", 7, "p", "d", 3, day, day, None, TEXT * 40)], schema)
    found = chunks.chunk_documents(docs)
    assert len(set(found.columns)) == len(found.columns) and {"_p", "_d", "_parts"} <= set(found.columns)
    rows = found.collect()
    assert len(rows) > 1 and {r["heading_path"] for r in rows} == {"s > t"} and {r["_p"] for r in rows} == {"p"}
    pieces = chunks.pack([x for x in (TEXT * 40).strip().replace(". ", ".|").replace("! ", "!|").replace("? ", "?|").split("|")], [chunks.words_count(x) for x in (TEXT * 40).strip().replace(". ", ".|").replace("! ", "!|").replace("? ", "?|").split("|")], 600)
    assert [r["display_text"] for r in rows] == pieces


def test_places_in_groups_without_a_task_a_group(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 2003).alias("k"))
    found = urls.rank_in_group(rows.repartition(6), ["g"], ["k"], "n").collect()
    groups = {}
    for r in sorted(found):
        groups.setdefault(r["g"], []).append(r["n"])
    assert len(found) == 2000 and all(n == list(range(1, len(n) + 1)) for n in groups.values())


def test_working_columns_leave_the_caller_s_alone(spark):
    rows = spark.createDataFrame([("a", 1, 10, 5, 6, 7), ("a", 2, 20, 5, 6, 7), ("b", 3, 30, 5, 6, 7)], "g string, k int, _n int, _h int, _latest int, _range int")
    assert sorted(r["_n"] for r in urls.dedupe_first(rows, ["g"], [F.desc("k")]).collect()) == [20, 30]
    assert sorted(r["_n"] for r in urls.cap_share(rows, "g", "g", 0.9, ["k"]).collect()) == [10, 30]
    assert [r["_latest"] for r in opendata.latest_only(rows, "k").collect()] == [6]
    found = audit.stratified_sample(rows, "g", 1, "k")
    assert found.columns == rows.columns and found.count() == 2


def test_longest_key_with_many_keys(spark, monkeypatch):
    names = spark.createDataFrame([(1, "Schweizerisches Obligationenrecht.pdf"), (2, "BV"), (3, "nothing")], "id int, name string")
    keys = spark.createDataFrame([("obligationenrecht",), ("recht",), ("bv",), ("ob",)], "key string")
    few = sorted((r["id"], r["key"]) for r in pages.match_longest_key(names, "name", "id", keys).collect())
    monkeypatch.setattr(pages, "KEYS_SENT", 1)
    assert sorted((r["id"], r["key"]) for r in pages.match_longest_key(names, "name", "id", keys).collect()) == few == [(1, "obligationenrecht"), (2, "bv"), (3, None)]


def test_nearest_with_many_cells_and_ties(spark, monkeypatch):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    once = sorted(retrieval.knn_topk(queries, vectors, 4).collect())
    monkeypatch.setattr(retrieval, "FIT_ROWS_A_CELL", 4)
    assert sorted(retrieval.knn_topk(queries, vectors.repartition(5), 4).collect()) == once and len(once) == 36
    assert [r["vec_id"] for r in once if r["query_id"] == 0] == [0, 15, 30, 45]
    assert retrieval.knn_topk(queries, vectors.limit(0), 4).count() == retrieval.knn_topk(queries.limit(0), vectors, 4).count() == 0


def test_law_answers_by_distinct_question(spark):
    laws = spark.createDataFrame([(i, "Obligationenrecht" if i % 2 else "Zivilgesetzbuch", f"Art. {i % 3} text") for i in range(40)], "chunk_id long, law_name string, display_text string")
    asked = spark.createDataFrame([(k, ["Art. 1 OR", "art 1", "§ 2 zgb", "nichts", "Artikel 9"][k % 5]) for k in range(50)], "query_id long, q string")
    number, law = retrieval.parse_law_query(F.col("q"))
    found = retrieval.law_article_lookup(asked.select("query_id", number.alias("article_no"), law.alias("law")), laws, 2).collect()
    by = lambda q: sorted(r["chunk_id"] for r in found if r["query_id"] == q)
    assert [by(k) for k in range(5)] == [[1, 7], [1, 4], [2, 8], [], []] and len(found) == 60


def test_context_is_cut_after_a_sentence(spark):
    hits = spark.createDataFrame([("q", 1, 5, "Eins zwei drei vier."), ("q", 2, 9, "Kurz hier. Der zweite Satz ist lang."), ("q", 3, 1, "Ende.")], "query_id string, rank int, token_count long, text string")
    rows = retrieval.context_budget(hits, 5, 8).orderBy("rank").collect()
    assert [(r["rank"], r["text"], r["running_tokens"]) for r in rows] == [(1, "Eins zwei drei vier.", 5), (2, "Kurz hier.", 7)]
    assert [r["rank"] for r in retrieval.context_budget(hits, 5, 6).collect()] == [1]
    assert [r["rank"] for r in retrieval.context_budget(hits, 2, 100).orderBy("rank").collect()] == [1, 2]


def test_late_readings_are_dropped(spark, tmp_path):
    place, out = tmp_path / "in", str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame([(k, datetime.datetime(2025, 1, 1, h, m), v) for k, h, m, v in rows], "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(place))
    write([("a", 1, 0, 1.0), ("a", 10, 0, 5.0)])
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(place))
    job = lambda: jobs.sensor_windows(stream, "k", "ts", "v").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    job()
    write([("a", 1, 30, 100.0), ("a", 9, 30, 7.0), ("a", 14, 0, 2.0)])  # the first is hours late, the second is not
    job()
    got = sorted((r["start"].hour, r["n"], r["mean"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1, 1.0), (9, 1, 7.0), (10, 1, 5.0)]


def test_rate_limit_stream_equals_batch(spark):
    one, other = (sorted(map(tuple, registry.QUERIES[name](spark, SF).collect())) for name in ("stream_rate_limit", "rate_limit"))
    assert one == other and 0 < sum(r[2] for r in one) < len(one)


def test_rate_limit_stream_keeps_state_between_runs(spark, tmp_path):
    place, out, second = tmp_path / "in", str(tmp_path / "out"), datetime.timedelta(seconds=1)
    start = datetime.datetime(2025, 1, 1)
    write = lambda at: spark.createDataFrame([("a", start + s * second) for s in at], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(place))
    stream = lambda: spark.readStream.schema("k string, ts timestamp").parquet(str(place))
    job = lambda: jobs.stream_rate_limit(stream(), "k", "ts", 10, 2).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    for at in ([0, 1, 2], [5, 11, 12], [5000]):
        write(at)
        job()
    got = sorted((int((r["ts"] - start).total_seconds()), r["accepted"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, True), (1, True), (2, False), (5, False), (11, True), (12, True), (5000, True)]


def test_transcripts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p", "s", [("user", "hi\nthere")], [0.5], None)], "persona_id string, seed string, transcript array<struct<role:string,content:string>>, latencies_s array<double>, errors array<string>")
    files.write_eval_results(rows, str(tmp_path / "t"))
    got = files.read_eval_results(spark, str(tmp_path / "t")).first()
    assert got["transcript"][0]["content"] == "hi\nthere" and got["verdict"] is None and got["latencies_s"] == [0.5]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a_0000", "a", "admin", "src"), ("b_0000", "b", "law", "src")], "chunk_id string, doc_id string, category string, source string")
    files.write_chunks(df, str(tmp_path / "kb"))
    got = files.read_chunks(spark, str(tmp_path / "kb")).select("chunk_id", "category", "source").collect()
    assert sorted(map(tuple, got)) == [("a_0000", "admin", "src"), ("b_0000", "law", "src")]
    with pytest.raises(ValueError):
        files.write_chunks(df.limit(0), str(tmp_path / "kb"))
    (tmp_path / "x.csv").write_text('﻿"Datum ",Wert\n2025-01-01,3\n', encoding="utf-8")
    assert files.read_open_csv(spark, str(tmp_path / "x.csv")).columns == ["Datum", "Wert"]
    (tmp_path / "b.xml").write_text("<baths><bath><title>See</title><temperatureWater>21.5</temperatureWater></bath></baths>")
    assert files.read_bath_xml(spark, str(tmp_path / "b.xml")).first()["temperatureWater"] == 21.5


def test_rate_limit_log():
    second = 1_000_000
    assert jobs.decide([0, second, 2 * second, 11 * second], [], 10, 2)[0] == [True, True, False, True]
    assert jobs.decide([0, 10 * second], [], 10, 1)[0] == [True, False]


def test_small_rules(spark):
    row = spark.range(1).select(
        evals.scrub_pii(F.lit("mail a@b.ch tel +41 44 123 45 67")).alias("pii"),
        opendata.duration_text(F.lit("00d01:05:00")).alias("d"),
        chunks.count_tokens(F.lit(None).cast("string")).alias("none"),
        pages.fold_name(F.lit("Gesetz über Bäume.pdf")).alias("name"),
    ).first()
    assert (row["pii"], row["d"], row["none"], row["name"]) == ("mail [email] tel [phone]", "1h 5min", 0, "gesetz_ueber_baeume_pdf")


def test_postcodes_behind_long_texts(spark):
    rows = [(1, "x " * 5000 + "8004 Zürich"), (2, "x " * 5000 + "18004"), (3, "8001"), (4, "x" * 996 + " 80012"), (5, None)]
    found = pages.region_filter(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert sorted(r["doc_id"] for r in found) == [1, 3]


def test_entry_without_llm():
    assert os.path.exists("__spark_entry__.py")
