"""Rows told apart whatever their ids, work in proportion to the input, files as promised, and the whole pipeline."""

import glob
import json
import time
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from .test_text_operators import ODD, slow_distance, slow_ppm, split

from cityjobs.llm import decontam, media, pieces, ppm, queries, quality, simhash, token_store, warc
from cityjobs.llm.common import prepare, scratch

SCHEMA = "doc_id long, text string, lang string"
A = "a plain row of some words that nobody else has in this table"
B = "quite another text about rivers and hills and a small boat on the lake"
C = "the third one speaks of bread and butter and of nothing else at all today"
ITEM = "what is the capital of the country that lies between the two great lakes"


# rows and ids


def test_one_row_of_each_group_whatever_the_ids(spark):
    prepare(spark)
    rows = [(5, A), (5, B), (3, B), (None, C), (None, B.upper()), (7, A), (7, A), (None, None), (9, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([("5", A), ("3", B), ("None", C), ("9", " ")])
    groups = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.similar_groups(docs).collect())
    assert groups == sorted([("5", "5"), ("5", "3"), ("3", "3"), ("None", "None"), ("None", "3"), ("7", "5"), ("7", "5"), ("None", "9"), ("9", "9")])


def test_fingerprint_components_with_null_and_repeated_ids(spark):
    prepare(spark)
    docs = spark.createDataFrame([(None, A, "x"), (4, A, "x"), (4, B, "x"), (None, C, "x")], SCHEMA)
    rows = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert rows == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**5, 10**8, 10**10)] == [6, 6, 8, 10]


def test_clean_rows_stay_and_contaminated_go_whatever_the_ids(spark):
    prepare(spark)
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    rows = [(5, A), (5, f"{B} {ITEM} {C}"), (None, ITEM.upper()), (None, C), (6, None), (7, ""), (8, A), (8, A)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).withColumn("item_id", F.lit(1)).withColumn("start", F.lit("s"))
    clean = decontam.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in clean.collect()) == sorted((str(i), str(t)) for i, t in [rows[0], rows[3], rows[4], rows[5], rows[6], rows[7]])
    assert decontam.keep_clean(docs.limit(0), bench).count() == 0
    assert decontam.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert sorted(str(r["doc_id"]) for r in decontam.contaminated(docs, bench).collect()) == ["5", "None"]
    assert decontam.contaminated(docs.limit(0), bench).count() == decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    prepare(spark)
    bench = spark.createDataFrame([(k, f"{ITEM} number {k * 1111}") for k in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{A} {ITEM} number {k * 1111} {B}", "x") for k in range(7)], SCHEMA)
    whole = sorted(decontam.contaminated(docs, bench).collect())
    kept = decontam.keep_clean(docs, bench).count()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    assert sorted(decontam.contaminated(docs, bench).collect()) == whole and len(whole) >= 5
    assert decontam.keep_clean(docs, bench).count() == kept


# repetitive texts and items


def test_repetitive_texts_and_items(monkeypatch):
    rng = np.random.default_rng(3)
    items = decontam.Items([0, 1, 2, 3], [b"a" * 60, b"ab" * 40, b"abc" * 30 + b"xyzxyz", b"no more than a plain sentence"])
    texts = []
    for _ in range(60):
        text = b"".join([[b"a" * 30, b"ab" * 20, b"abc" * 15, b"zzz ", b"q"][int(rng.integers(5))] for _ in range(int(rng.integers(1, 8)))])
        texts.append(bytes(text))
    want = {}
    for t, text in enumerate(texts):
        for i in range(4):
            d = slow_distance(items.texts[i], text)
            if d <= items.edits[i]:
                want[t, i] = d
    found = {(t, i): d for t, i, d, *_ in decontam.search(texts, items)}
    assert found == want and len(want) > 20
    for hits, few, piece in ((7, 4, 1 << 20), (1 << 21, 0, 1 << 20), (1 << 21, 10**6, 64)):
        monkeypatch.setattr(decontam, "HITS", hits)
        monkeypatch.setattr(decontam, "FEW", few)
        monkeypatch.setattr(decontam, "PIECE", piece)
        again = decontam.Items(items.ids, items.texts)
        assert {(t, i): d for t, i, d, *_ in decontam.search(texts, again)} == want


def test_one_letter_a_hundred_thousand_times():
    items = decontam.Items([0], [b"a" * 1000])
    start = time.time()
    assert decontam.search([b"a" * 100_000], items)[0][2] == 0
    assert decontam.likely_bands(b"ab" * 50_000, items)[0].size == 0
    assert time.time() - start < 20


# pages


class Slow(HTMLParser):
    """The same by the library's parser, for pages whose tags are all closed."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.out, self.hidden, self.in_title = None, [], [], 0, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        names = {}
        for k, v in attrs:
            names.setdefault(k, v)
        if tag == "title":
            self.in_title = True
        elif tag in ("script", "style"):
            self.hidden += 1
        elif not self.hidden:
            if tag == "a" and "href" in names:
                self.links.append(names["href"] or "")
        self.out.append("" if tag in warc.INLINE else "\n")

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        self.hidden -= tag in ("script", "style")
        self.out.append("" if tag in warc.INLINE else "\n")

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.hidden:
            self.out.append(data.replace("\n", " "))


def test_pages_as_the_library_reads_them():
    rng = np.random.default_rng(9)
    parts = ['<p class="a>b">One', "</p>", "<b>two</b>", "\n three &amp; four ", "<!-- <a href='no'> -->", "<script>if (a < b) '<a href=x>'</script>", "<a data-href='x' HREF = \"/y?a=1&amp;b=2\">go</a>", "<a href=plain/link>k</a>", "<br/>", "<div\tid='q'>", "</div>", "<title>T &lt; U</title>", "<style>p > a</style>", "<a title='a>b' href='z' href='later'>l</a>"]
    for _ in range(300):
        page = "".join(rng.choice(parts, int(rng.integers(1, 25))))
        if page.count("<title>") > 1:
            continue
        slow = Slow(page)
        title, links, text = warc.scan(page)
        assert links == slow.links, page
        assert title == (slow.title.strip() if slow.title else None)
        assert text == warc.LINES.sub("\n", warc.BLANK.sub(" ", "".join(slow.out))).strip(), page


@pytest.mark.parametrize("unit", ["<!--", "<script>", "<title>", "<a ", '<a x="', "<a href=", "<a x='<a x=\"", "<a b =  ", "<", "<noscript>", "<a b\t\t\t", "</", "&#9", "<a b=c"])
def test_time_in_proportion_whatever_the_markup(unit):
    took = []
    for n in (250_000, 1_000_000):
        page = unit * (n // len(unit))
        start = time.time()
        warc.scan(page)
        took.append(time.time() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_given_responses_are_preserved(spark):
    schema = "page_id long, url string, html string, status string, headers map<string,string>, fetched string, rid string"
    rows = [(1, "http://a/", "<p>x", "HTTP/1.1 404 Not Found", {"Server": "s\r\nX: y", "Content-Type": "text/html"}, "2024-05-06T07:08:09Z", "<urn:uuid:1>"), (2, "http://b/", "", None, None, None, None)]
    pages = spark.createDataFrame(rows, schema)
    got = warc.derivatives(pages, status="status", headers="headers", dates="fetched", record_ids="rid", responses=True).collect()
    assert [r["record_type"] for r in got] == ["response", "metadata", "conversion"] * 2
    own, meta, text = got[:3]
    assert own["record_id"] == meta["refers_to"] == text["refers_to"] == "<urn:uuid:1>" and own["refers_to"] is None
    assert {r["date"] for r in got[:3]} == {"2024-05-06T07:08:09Z"}
    assert b"HTTP/1.1 404 Not Found\r\nServer: s X: y\r\n" in bytes(own["record"])
    found = json.loads(bytes(meta["record"]).partition(b"\r\n\r\n")[2])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert found["Response-Message"] == "HTTP/1.1 404 Not Found" and found["Headers"]["Server"] == "s X: y"
    assert got[3]["record_id"] == got[4]["refers_to"] and b"200 OK" in bytes(got[3]["record"])
    assert warc.derivatives(pages.limit(0)).count() == 0
    lines = warc.derivatives(pages.withColumn("headers", F.lit("A: 1\r\nB: 2")), headers="headers", responses=True).first()
    assert b"\r\nA: 1\r\nB: 2\r\n" in bytes(lines["record"])


# scores of a trie in many shards


def test_shards_of_any_limits_give_the_same_costs():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "then", "there", "a", "an", "and", "anthem"], int(rng.integers(1, 40)))).encode() for _ in range(40)]
    want, _ = slow_ppm(texts[:30], texts)
    keys, starts = ppm.codes([s for t in texts for s in ppm.segments(t)])
    owner = np.repeat(np.arange(40), np.diff(np.append(starts, len(keys))))
    code = np.unique(keys)
    n = np.bincount(np.searchsorted(code, keys), (owner < 30).astype(float), len(code)).astype(np.int64)
    low, inverse = np.unique(code >> 32, return_inverse=True)
    one = np.zeros((256, 256), np.int64)
    one[low & 255, low >> 8] = np.bincount(inverse, n, len(low))
    contexts = np.unique(code & ppm.CONTEXT)
    for bounds in (np.zeros(0, np.int64), contexts[1::7], np.sort(rng.choice(contexts, 3, replace=False)), contexts[1:]):
        shard = ppm.shard_of(code, bounds)
        cost = np.zeros(len(code))
        edges = ppm.edges(code, n, bounds)
        for s in np.unique(shard).tolist():
            cost[shard == s] = ppm.resolve(code[shard == s], n[shard == s], one, *edges.get(s, ()))
        got = np.bincount(owner, cost[np.searchsorted(code, keys)], 40)
        assert got == pytest.approx(want, rel=1e-9)


def test_many_shards_and_batches(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice("to be or not that is the question".split(), int(rng.integers(1, 30))))) for i in range(80)] + [(1, None), (None, "to be"), (None, "to be")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as b", "2 as shard", "'s' as score")
    few = sorted(ppm.score_documents(docs).collect(), key=str)
    monkeypatch.setattr(ppm, "LEAST_SHARDS", 3)
    monkeypatch.setattr(ppm, "LEAST_BATCHES", 2)
    assert [tuple(r)[:-1] for r in sorted(ppm.score_documents(docs).collect(), key=str)] == [tuple(r)[:-1] for r in few]
    assert len(few) == len(rows) and few[0]["train_tokens"] > 0
    # shards far more than codes: a batch has rows for those alone that it has something for
    monkeypatch.setattr(ppm, "LEAST_SHARDS", 3_000)
    asked = []
    monkeypatch.setattr(ppm, "scratch", lambda s, name: asked.append(scratch(s, name)) or asked[-1])
    assert [tuple(r)[:-1] for r in sorted(ppm.score_documents(docs).collect(), key=str)] == [tuple(r)[:-1] for r in few]
    sent = spark.read.parquet(asked[0]).where("shard >= 0")
    assert 0 < sent.count() < 2 * 700 and sent.where("length(code) = 0 and length(word) = 0").count() == 0


# files of token ids


def test_token_files_have_dictionaries_deltas_small_row_groups_and_page_indexes(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(token_store, "ROW_GROUP_BYTES", 1 << 16)
    monkeypatch.setattr(token_store, "PAGE_BYTES", 1 << 12)
    path, out = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "files")
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i * 3, " ".join(rng.choice(["lake", "river", "bridge", "tram", "x1", "don't"], 200))) for i in range(3000)], "doc_id long, text string")
    token_store.write_tokens(docs.coalesce(1), out, path)
    files = sorted(glob.glob(f"{out}/*.parquet"))
    groups = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert any("DICTIONARY" in x for x in ids.encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["shard_start"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert groups > 1
    some = token_store.read_tokens(spark, out).where("doc_id between 600 and 660").collect()
    assert [r["doc_id"] for r in sorted(some)] == list(range(600, 661, 3))
    plan = token_store.read_tokens(spark, out).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_a_full_table_of_chunks_keeps_what_occurs_again(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"tram {k} lake{k} bridge river don't {'x' * 70}{k}".encode() for k in range(60)]
    whole = token_store.WordTable(path, 2).encode(texts)
    monkeypatch.setattr(token_store, "TABLE_ROWS", 5)
    table = token_store.WordTable(path, 2)
    assert [table.encode([t])[0] for t in texts] == whole
    assert len(table.ids) + len(table.old) < 40
    monkeypatch.setattr(pieces, "TABLE_ROWS", 5)
    model = public_tokenizers.path("piece_bpe_32k.model")
    table = pieces.ChunkTable(model)
    assert [table.encode([t.decode()])[0] for t in texts] == [pieces.ChunkTable(model).encode([t.decode()])[0] for t in texts]


# odd tables for the rest, and the pipeline


def test_odd_tables(spark):
    prepare(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, t) for i, t in ODD] + [(None, A)], "doc_id long, text string").selectExpr("*", "'w' as wav", "1 as ids", "2 as n_tokens", "3 as shard", "'f' as feature")
    for found in (media.digests(docs), media.media(docs), pieces.digests(docs, path), pieces.encode(docs, path)):
        rows = found.collect()
        assert len(rows) == len(ODD) + 1 and sum(r["doc_id"] is None for r in rows) == 1
        twice = [tuple(r)[1:] for r in rows if r["doc_id"] == 2]
        assert twice[0] == twice[1]
    for found in (media.digests, media.media):
        assert found(docs.limit(0)).count() == 0
    for found in (pieces.digests, pieces.encode):
        assert found(docs.limit(0), path).count() == 0
    out = scratch(spark, "odd")
    token_store.write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_tokens(spark, out).count() == len(ODD) + 1


def test_pieces_stage_is_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = dict(ODD)
    for r in pieces.encode(spark.createDataFrame(ODD, "doc_id long, text string"), path).collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)


def test_pipeline_stages_one_by_one(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns
        path = scratch(spark, name)
        kept.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.exceptAll(docs).count() == 0  # rows are kept or go, as they are
        sizes.append((docs.count(), after.count()))
        docs = after
    assert all(b <= a for a, b in sizes) and sizes[-1][1] > 0.5 * sizes[0][0]
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # by hand: no two texts left are alike, none holds a benchmark item
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (split(t) for _, t in left)]
    assert not any(len(x & y) >= 0.8 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    items = [decontam.canonical(r["text"].encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(item and item in decontam.canonical(t.encode()) for _, t in left for item in items)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in left)
    ids = dict(pieces.encode(docs, queries.PIECE_MODEL).collect())
    assert all(r["ids"] == ids[r["doc_id"]] for r in got)


def test_registered_quality_query_uses_no_labels_of_the_held_out_fold(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (sorted(quality.scored(docs, x).collect()) for x in (labels, turned))
    assert one == other
