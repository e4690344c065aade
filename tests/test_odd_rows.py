"""Queries against their SQL on made rows that the given tables lack."""

import duckdb
import pytest

from cityjobs.plans import answers, corpus, feeds, registry  # noqa: F401


@pytest.fixture
def differing(spark, tmp_path):
    """Gives a function: rows that a query and its SQL do not share, over documents (doc_id, text, lang)."""

    def run(name, rows):
        place = f"{tmp_path}/documents.parquet"
        given = [(i, text, lang, "web", len(text or "")) for i, text, lang in rows]
        spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(place)
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{place}/*.parquet')")
        df = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
        got = sorted(map(repr, map(tuple, df.collect())))
        return [x for x in zip(got, sorted(map(repr, want)), strict=True) if x[0] != x[1]]

    return run


#: Figures at the places of their own numbers, blanks of every kind, repeated lines that blanks tell apart.
LINES = ["a\n1232 b1\n2 c 2\n33", "0997 x\ny0", " a \na\n a \n\n  \nb", "\n\n", "", " ", None, "0\n1\n2\n3\n4", "\ta\n a\t", "1. a\n 2. b\n\n3 c. D 1\n4 e"]


@pytest.mark.parametrize("name", ["dedupe_paragraphs", "drop_index_pages"])
def test_lines_lose_their_blanks_alone(differing, name):
    assert differing(name, [(k, t, "de") for k, t in enumerate(LINES)]) == []


def test_paths_keep_an_empty_heading(differing):
    texts = ["", None, " ", "\n", "a", "🙂" * 20, "e\u0301" * 8, "🇩🇪" * 6, "x" * 100]
    assert differing("heading_and_embed_text", [(k, t, lang) for k, (t, lang) in enumerate((t, lang) for t in texts for lang in ("de", "", None))]) == []


#: Whole texts around the length at which chunks are cut by default, documents without language.
STORED = [(k, t, lang) for k, (t, lang) in enumerate((t, lang) for t in ("x" * 80_001, "word. Next " * 9_000, "", None, "short", " a \n") for lang in ("de", None, "fr", ""))]


def test_stream_stores_whole_texts(differing):
    assert differing("stream_upsert", STORED) == []


def test_store_keeps_whole_texts(differing):
    assert differing("upsert_store", STORED) == []
