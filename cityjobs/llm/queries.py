"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hyperplane_tree, langid, line_runs, media, pieces, ppm, quality, ranked_blocks, simhash, token_store, toxicity, warc
from .common import prepare, scratch, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and wordless texts have the fingerprint 0; a row for each row, see simhash.near_duplicates."""
    prepare(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; a row for each row, see ppm.score_documents."""
    prepare(spark)
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and n_chars alone are inputs. Null texts count as empty; a row for each row, see quality.scored."""
    prepare(spark)
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=("n_chars",))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records a page. The pages hold no responses: status, headers and date are made up, see warc.derivatives."""
    prepare(spark)
    found = warc.derivatives(table(spark, sf_dir, "pages"))
    return found.select(*[c for c in found.columns if c != "record"], F.sha2("record", 256).alias("record_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`und` for null, empty and letterless texts; a row for each row, see langid.identified."""
    prepare(spark)
    return langid.identified(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; a row for each row, see toxicity.scored."""
    prepare(spark)
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; a row for each row, see media.digests."""
    prepare(spark)
    return media.digests(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; a row for each row, see pieces.digests."""
    prepare(spark)
    return pieces.digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the shared folder and read back. Null texts have the end id alone, see token_store.read_tokens."""
    prepare(spark)
    path = scratch(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, WORD_MODEL)
    return token_store.digests(token_store.read_tokens(spark, path))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for contaminated documents alone; null and empty texts match nothing, see decontam.contaminated."""
    prepare(spark)
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no terms; every benchmark item against all documents, see ranked_blocks.ranked."""
    prepare(spark)
    return ranked_blocks.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one empty line, which stays; a row for each row, see line_runs.drop_common_lines."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = line_runs.drop_common_lines(docs, line_runs.batches_of(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without label or with a null, NaN or infinite component take no part, see hyperplane_tree.hard_negatives."""
    prepare(spark)
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hyperplane_tree.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of the documents that all stages keep, see corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_ppm, op3_quality, op4_warc, op5_langid, op6_toxicity, op7_media, op8_pieces, op9_token_store, op10_decontam, op11_ranked_blocks, op12_line_runs, op13_hard_negatives, pipeline)
}
TERMS_SQL = f"regexp_extract_all(translate(text, '{line_runs.UPPER}', '{line_runs.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES: dict[str, str] = {
    "op11_ranked_blocks": f"""with d as (select doc_id, row_number() over () as r, {TERMS_SQL} as l from documents),
i as (select item_id, row_number() over () as q, unnest({TERMS_SQL}) as term from benchmark), v as (select distinct term from i),
s as (select count(*) as n, cast(sum(len(l)) as bigint) as total from d where len(l) > 0),
t as (select r, term, count(*) as tf from (select r, unnest(l) as term from d) semi join v using (term) group by all),
w as (select term, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) as w from t, s group by term, n),
c as (select r, doc_id, 75 + (25 * len(l) * n) // total as m from d, s),
p as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) as points from t join w using (term) join c using (r)),
f as (select item_id, q, r, doc_id, cast(sum(points) as bigint) as score from i join p using (term) group by all)
select item_id, row_number() over (partition by q order by score desc, doc_id) as rank, doc_id, score from f where score > 0 qualify rank <= 20""",
    "op12_line_runs": f"""with d as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select r, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from d),
k as (select r, i, line, translate(trim(line, {BLANKS_SQL}), '{line_runs.UPPER}', '{line_runs.LOWER}') as key from x),
c as (select key from k where key <> '' group by key having count(distinct r) >= 10),
t as (select r, string_agg(line, chr(10) order by i) as kept, count(*) as n from k where key not in (select key from c) group by r)
select doc_id, len(l) as n_lines, len(l) - coalesce(n, 0) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from d left join t using (r)""",
    "op13_hard_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score from p join s using (anchor_id) where not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select *, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as rank from n qualify rank <= 5""",
}
