"""Queries of retrieval, conversations and evaluation over `embeddings`, `documents`, `conversations` and `labels`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, evals, retrieval
from .corpus import TOKENS_SQL
from .registry import query, table

KNN_SQL = """select q.vec_id as query_id, v.vec_id, round(1 - list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 4) + 0.0 as distance
from embeddings q, embeddings v where q.vec_id % 20 = 0"""


def knn(spark: SparkSession, sf_dir: str, k: int, where=None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.knn_topk(queries, vectors, k, where)


@query(f"select query_id, vec_id, distance, rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from ({KNN_SQL})) where rank <= 10")
def knn_topk(spark, sf_dir):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return knn(spark, sf_dir, 10)


@query(f"select query_id, vec_id, distance, rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from ({KNN_SQL} and v.label in (1, 2))) where rank <= 5")
def filtered_search(spark, sf_dir):
    return knn(spark, sf_dir, 5, F.col("label").isin(1, 2))


@query("select doc_id, 'title: none | text: ' || text as document, 'task: search result | query: ' || text as query from documents")
def prompt_wrap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.wrap_document(F.col("text")).alias("document"), retrieval.wrap_query(F.col("text")).alias("query"))


@query("""select doc_id, list_position(v, list_max(v)) as top, case when list_max(v) > 0 then 1.0 else 0.0 end as norm, 5 as dim
from (select doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: length(text) - length(replace(text, c, ''))) as v from documents)""")
def embed_texts(spark, sf_dir):
    """A pluggable encoder: here the numbers of vowels, as no model is shipped; the largest component and the norm."""
    import numpy as np

    def vowels(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in "aeiou"] for t in texts], np.float32)

    found = retrieval.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vowels)
    return found.select("doc_id", F.array_position("embedding", F.array_max("embedding")).alias("top"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), F.size("embedding").alias("dim"))


HITS_SQL = "select conv_id as query_id, turn as rank, role as source_name, case when turn % 3 = 0 then 'local://x' when turn % 3 = 1 then '' else 'https://x.ch/' || role end as source_url, text from conversations"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("turn") % 3 == 0, "local://x").when(F.col("turn") % 3 == 1, "").otherwise(F.concat(F.lit("https://x.ch/"), "role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("source_name"), url.alias("source_url"), "text")


@query(f"""with h as ({HITS_SQL}), f as (select query_id, source_name, min(rank) as rank, arg_min(case when trim(source_url) <> '' and not starts_with(source_url, 'local://') then source_url else '' end, rank) as url from h group by all)
select query_id, string_agg(trim(source_name || ' ' || url), '; ' order by rank, source_name) as sources from f group by query_id""")
def cite_sources(spark, sf_dir):
    return retrieval.cite_sources(hits(spark, sf_dir)).select("query_id", F.array_join("sources", "; ").alias("sources"))


#: Questions: each document whose id is divisible by 20, as a whole, after a question for an article of a law or for none.
ASKED = """concat(case when doc_id % 100 = 0 then 'Was gilt' when doc_id % 3 = 0 then concat('Was sagt Art. ', doc_id % 9 + 1) when doc_id % 3 = 1 then concat('§', doc_id % 9 + 1) else concat('artikel', doc_id % 400 + 1) end,
case doc_id % 7 when 0 then ' OR' when 1 then ' zgb' when 2 then ' Verkehrsregeln' when 3 then ' orte' else '' end, ' zu ', text)"""
LAW = "case " + " ".join(f"when regexp_matches(lower(q), '\\b{word}\\b') then '{name}'" for word, name in retrieval.LAW_NAMES.items()) + " end"
QUERIES_SQL = f"""select query_id, nullif(lower(regexp_extract(q, '(?i)(?:art(?:ikel)?\\.?\\s*|§\\s*)(\\d+[a-z]?)\\b', 1)), '') as article_no, {LAW} as law
from (select doc_id as query_id, {ASKED} as q from documents where doc_id % 20 = 0)"""


def law_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.expr(ASKED).alias("q"))
    number, law = retrieval.parse_law_query(F.col("q"))
    return rows.select("query_id", number.alias("article_no"), law.alias("law"))


@query(QUERIES_SQL)
def parse_law_query(spark, sf_dir):
    return law_queries(spark, sf_dir)


#: Documents as statute articles: number and law from the id, the whole text behind.
LAW_TITLES = ["Strafgesetzbuch", "Obligationenrecht (OR)", "Zivilgesetzbuch", "Bundesverfassung"]
LAW_TEXT = "concat(case when doc_id % 5 = 0 then 'Art ' else 'Art. ' end, doc_id % 400 + 1, case when doc_id % 6 = 0 then 'a ' else ' ' end, text)"
LAW_CHUNKS_SQL = f"select doc_id as chunk_id, ({LAW_TITLES})[doc_id % 4 + 1] as law_name, {LAW_TEXT} as display_text from documents"


def law_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = F.element_at(F.array(*map(F.lit, LAW_TITLES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), law.alias("law_name"), F.expr(LAW_TEXT).alias("display_text"))


LOOKUP_SQL = f"""select query_id, chunk_id, display_text, score, rank from (select query_id, chunk_id, display_text, 1.0::double as score, row_number() over (partition by query_id order by chunk_id) as rank
from ({QUERIES_SQL}) q join (select *, unnest(list_distinct(list_transform(regexp_extract_all(display_text, '(?i)\\bart\\.\\s*(\\d+[a-z]?)\\b', 1), lambda x: lower(x)))) as article_no from ({LAW_CHUNKS_SQL})) c
using (article_no) where law is null or contains(upper(law_name), law)) where rank <= 3"""


@query(f"select query_id, chunk_id, score, rank from ({LOOKUP_SQL})")
def law_article_lookup(spark, sf_dir):
    return retrieval.law_article_lookup(law_queries(spark, sf_dir), law_chunks(spark, sf_dir), 3)


NOISE_SQL = """(select n > 4 and (words < n * 5 or notes > n * 0.3) from (select len(l) as n, coalesce(list_sum(list_transform(l, lambda x: len(regexp_split_to_array(x, '\\s+')))), 0) as words,
len(list_filter(l, lambda x: regexp_matches(x, '\\d{{3,}}\\s+AS \\d{{4}}'))) as notes from (select list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l)))"""


@query(f"select doc_id, {NOISE_SQL.format(t='text')} as noise from documents")
def drop_noise_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.is_noise_chunk(F.col("text")).alias("noise"))


@query(f"""with k as (select query_id, chunk_id, score, rank from ({LOOKUP_SQL}) where not {NOISE_SQL.format(t='display_text')}),
n as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from ({KNN_SQL})),
d as (select query_id, chunk_id, distance as score, row_number() over (partition by query_id order by rank) as rank from n join ({LAW_CHUNKS_SQL}) on chunk_id = vec_id
where rank <= 15 and query_id in (select doc_id from documents) and query_id not in (select query_id from k) and not {NOISE_SQL.format(t='display_text')})
select query_id, chunk_id, score, rank, 'keyword' as via from k union all select query_id, chunk_id, score, rank, 'dense' from d where rank <= 3""")
def law_search(spark, sf_dir):
    """Documents whose id is divisible by 20 as questions, with their own vectors, against all documents as statutes."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = law_queries(spark, sf_dir).join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    return retrieval.law_search(asked, law_chunks(spark, sf_dir), vectors, 3)


@query("select conv_id as query_id, case when turn % 2 = 1 then turn - 1 else turn end as chunk_id, min(turn) as rank from conversations group by 1, 2")
def expand_to_parent(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    family = turns.selectExpr("turn as chunk_id", "case when turn % 2 = 1 then turn - 1 end as parent_chunk_id").distinct()
    return retrieval.expand_to_parent(turns.selectExpr("conv_id as query_id", "turn as chunk_id", "turn as rank"), family)


TURNS_SQL = f"select conv_id, turn, role, {TOKENS_SQL.format(t='text')} as tokens from conversations"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", chunks.count_tokens(F.col("text")).alias("tokens"))


#: Running sums over the turns, then over the sentences of the turn that goes beyond the budget.
BUDGET_SQL = f"""with t as (select conv_id as query_id, turn as rank, text, tokens, sum(tokens) over (partition by conv_id order by turn rows unbounded preceding) as running from (select *, {TOKENS_SQL.format(t='text')} as tokens from conversations) where turn <= 6),
s as (select query_id, rank, unnest(p) as sentence, unnest(range(1, len(p) + 1)) as i from (select query_id, rank, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+([A-ZÄÖÜ])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') as p from t where running > 120)),
c as (select query_id, rank, sum({TOKENS_SQL.format(t='sentence')}) over (partition by query_id, rank order by i rows unbounded preceding) as n from s),
k as (select t.query_id, t.rank, any_value(t.running - t.tokens) + max(n) as running from c join t using (query_id, rank) where n <= 120 - (t.running - t.tokens) and t.running - t.tokens < 120 group by all)
select query_id, rank, running as running_tokens from t where running <= 120 union all select query_id, rank, running from k"""


@query(BUDGET_SQL)
def context_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", chunks.count_tokens(F.col("text")).alias("token_count"))
    return retrieval.context_budget(rows, 6, 120).select("query_id", "rank", "running_tokens")


@query("select conv_id, turn, trim(lower(text)) = '' or contains(lower(text), 'no results') or contains(lower(text), 'keine ergebnisse') or contains(lower(text), 'not found') as needs_web from conversations")
def flag_empty_retrieval(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.flag_empty_retrieval(F.col("text")).alias("needs_web"))


#: A verdict for each labelled document: scores from its labels, patterns and gaps from its id.
RAW = """concat(case when doc_id % 10 = 0 then 'no verdict' when doc_id % 10 = 1 then '{bad' else concat('Sure: {"scores":{"factual":', quality + doc_id % 4, ',"tone":', 5 - toxic,
'},"patterns":["p', doc_id % 3, '","p', doc_id % 5, '"],"connector_gap":', case when doc_id % 4 = 0 then '"null"' when doc_id % 4 = 1 then 'null' else concat('"gap', doc_id % 6, '"') end, '}') end, case when doc_id % 10 = 1 then '}' else ' .' end)"""
VERDICTS_SQL = """select doc_id as conv_id, 'persona' || doc_id % 7 as persona_id, (quality + doc_id % 4)::double as factual, (5 - toxic)::double as tone,
['p' || doc_id % 3, 'p' || doc_id % 5] as patterns, case when doc_id % 4 > 1 then 'gap' || doc_id % 6 end as connector_gap from labels where doc_id % 10 > 1"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), F.concat(F.lit("persona"), F.col("doc_id") % 7).alias("persona_id"), F.expr(RAW).alias("raw"))
    return evals.parse_verdicts(rows, "raw")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).where("error is null").select("conv_id", "persona_id", "verdict.*")


@query("select doc_id as conv_id, case when doc_id % 10 = 0 then 'judge_no_json' when doc_id % 10 = 1 then 'judge_bad_json' end as error from labels")
def parse_judge_json(spark, sf_dir):
    return verdicts(spark, sf_dir).select("conv_id", "error")


@query(f"select 'factual' as axis, round(avg(factual), 2) as score from ({VERDICTS_SQL}) union all select 'tone', round(avg(tone), 2) from ({VERDICTS_SQL})")
def axis_averages(spark, sf_dir):
    return evals.axis_scores(results(spark, sf_dir))


@query(f"select persona_id, round(avg(factual), 2) as factual, round(avg(tone), 2) as tone from ({VERDICTS_SQL}) group by persona_id")
def persona_scoreboard(spark, sf_dir):
    return evals.persona_scores(results(spark, sf_dir), ["factual", "tone"])


@query(f"select pattern, count(*) as n from (select unnest(patterns) as pattern from ({VERDICTS_SQL})) group by pattern")
def pattern_counts(spark, sf_dir):
    return evals.pattern_counts(results(spark, sf_dir))


@query(f"select connector_gap, count(*) as n from ({VERDICTS_SQL}) where connector_gap is not null group by 1")
def gap_counts(spark, sf_dir):
    return evals.gap_counts(results(spark, sf_dir))


@query(f"select conv_id, connector_gap as gap from ({VERDICTS_SQL}) where connector_gap is not null order by conv_id limit 20")
def gap_list(spark, sf_dir):
    return evals.gap_list(results(spark, sf_dir), "connector_gap")


@query(f"select conv_id, factual + tone as total from ({VERDICTS_SQL}) order by total, conv_id limit 10")
def worst_conversations(spark, sf_dir):
    return evals.worst_conversations(results(spark, sf_dir), 10).select("conv_id", "total")


@query(f"select conv_id, total from (select conv_id, factual + tone as total from ({VERDICTS_SQL}) union all select doc_id, 0.0 from labels where doc_id % 10 <= 1) order by total, conv_id limit 10")
def worst_with_missing_first(spark, sf_dir):
    """Conversations without a verdict come first."""
    rows = verdicts(spark, sf_dir).select("conv_id", F.col("verdict.scores").alias("scores"))
    return evals.worst_conversations(rows, 10, missing="first").select("conv_id", "total")


@query("select conv_id, string_agg('[' || upper(role) || ' ' || i || '] ' || substr(text, 1, 700), chr(10) order by i) as transcript from (select *, row_number() over (partition by conv_id order by turn) - 1 as i from conversations) where i < 8 group by conv_id")
def render_transcript(spark, sf_dir):
    return evals.render_transcript(table(spark, sf_dir, "conversations"), 700, 8)


@query("select conv_id, round(avg(length(text) / 1000.0), 3) as mean_latency from conversations group by conv_id")
def latency_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text") / 1000).alias("latencies_s"))
    return evals.latency_stats(rows)


@query(f"""with s as (select persona_id, unnest([{{'axis': 'factual', 's': factual}}, {{'axis': 'tone', 's': tone}}], recursive := true), conv_id from ({VERDICTS_SQL})),
b as (select persona_id, axis, s + case axis when 'factual' then 1 else 0 end as s from s),
a as (select axis, avg(s) v from s group by axis), ab as (select axis, avg(s) v from b group by axis), p as (select persona_id, sum(s) v from s group by 1), pb as (select persona_id, sum(s) v from b group by 1)
select * from (select 'axis' as kind, a.axis as name, round(a.v - ab.v, 2) as delta from a join ab using (axis)) where delta < -0.5
union all select * from (select 'persona_id', persona_id, round(p.v - pb.v, 2) as delta from p join pb using (persona_id)) where delta < -3""")
def regression_check(spark, sf_dir):
    now = results(spark, sf_dir).select("persona_id", F.explode("scores").alias("axis", "score"))
    return evals.regression_check(now, now.withColumn("score", F.col("score") + F.when(F.col("axis") == "factual", 1).otherwise(0)))


REPLY_SQL = "case turn % 5 when 0 then concat(text, ' [Quelle: x]') when 1 then concat('See [this](http://x) ', text) when 2 then concat(text, ' weather now') when 3 then concat('[1] http://x ', text) else concat('Das ist nicht die aktuell ', text) end"
ASK_SQL = "case conv_id % 3 when 0 then 'Wo ist das und was ist der Plan' when 1 then 'where is the plan and what can you do' else '' end"


def count_sql(text: str, lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in evals.LANGUAGE_WORDS[lang])
    return f"len(list_filter(string_split(regexp_replace(lower({text}), '[^\\w\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g'), ' '), lambda w: w in ({words})))"


def language_sql(text: str) -> str:
    n = {lang: count_sql(text, lang) for lang in evals.LANGUAGE_WORDS}
    return f"case when greatest({', '.join(n.values())}) = 0 then null " + " ".join(f"when {c} = greatest({', '.join(n.values())}) then '{lang}'" for lang, c in n.items()) + " end"


@query(f"""select conv_id, turn, coalesce({language_sql('ask')} = {language_sql('reply')}, true) as language_ok, regexp_matches(reply, '\\[Quelle:|\\[[^\\]]+\\]\\([^)\\s]+\\)') or contains(lower(reply), 'weather') as has_citations,
length(reply) <= 2000 as length_ok, turn % 3 > 0 and role <> 'user' as tools_ok, not regexp_matches(reply, '(?i)\\b(right now|currently|aktuell|jetzt)\\b') or turn % 3 > 0 as realtime_ok
from (select *, {ASK_SQL} as ask, {REPLY_SQL} as reply from conversations)""")
def hard_checks(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(ASK_SQL).alias("question"), F.expr(REPLY_SQL).alias("reply"), F.when(F.col("turn") % 3 > 0, F.array(F.lit("weather"))).otherwise(none).alias("called"), F.array(F.lit("weather")).alias("expected"),
        F.when(F.col("role") == "user", F.array(F.lit("weather"))).otherwise(none).alias("forbidden"),
    )
    return evals.hard_checks(rows, ["weather"], ["weather"]).select("conv_id", "turn", "language_ok", "has_citations", "length_ok", "tools_ok", "realtime_ok")


@query(f"""select conv_id, turn, running from (select *, sum(case when role = 'system' then 0 else tokens end) over (partition by conv_id order by turn desc, role desc rows unbounded preceding) as running,
row_number() over (partition by conv_id order by turn desc, role desc) as n from ({TURNS_SQL})) where running <= 300 or role = 'system' or n = 1""")
def truncate_history(spark, sf_dir):
    return evals.truncate_history(turns(spark, sf_dir), 300).select("conv_id", "turn", "running")


@query(f"select conv_id, turn, sum(tokens) over (partition by conv_id order by turn, role rows unbounded preceding) as running, sum(tokens) over (partition by conv_id order by turn, role rows unbounded preceding) > 500 as over_cap from ({TURNS_SQL})")
def conversation_cap(spark, sf_dir):
    return evals.conversation_cap(turns(spark, sf_dir), 500).select("conv_id", "turn", "running", "over_cap")


COST = "(tokens * case turn % 2 when 0 then 0.2 else 2.5 end + length(role) * 10 * case turn % 2 when 0 then 0.8 else 10.0 end) / 1000000"


def usage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = turns(spark, sf_dir).selectExpr("conv_id", "turn", "case turn % 2 when 0 then 'small' else 'large' end as model", "tokens as input_tokens", "length(role) * 10 as output_tokens", "date_add(date'2025-01-01', cast(conv_id % 60 as int)) as day")
    return rows, spark.createDataFrame([("small", 0.2, 0.8), ("large", 2.5, 10.0)], "model string, price_in double, price_out double")


@query(f"select conv_id, turn, round(cast({COST} as double), 8) as cost from ({TURNS_SQL})")
def turn_cost(spark, sf_dir):
    return evals.turn_cost(*usage(spark, sf_dir)).select("conv_id", "turn", F.round("cost", 8).alias("cost"))


@query(f"""select month, date, conv_id, round(sum(cost), 6) as cost, count(*) as turns from (select strftime(day, '%Y-%m') as month, strftime(day, '%Y-%m-%d') as date, conv_id, cost
from (select date '2025-01-01' + cast(conv_id % 60 as int) as day, conv_id, cast({COST} as double) as cost from ({TURNS_SQL}))) group by rollup (month, date, conv_id)""")
def cost_rollup(spark, sf_dir):
    return evals.cost_rollup(*usage(spark, sf_dir))


@query("""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+', '[email]', 'g'), '\\b[A-Z]{2}\\d{2}[A-Z0-9]{11,30}\\b', '[iban]', 'g'), '\\+?\\d[\\d ()/-]{7,}\\d', '[phone]', 'g') as text from documents""")
def scrub_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evals.scrub_pii(F.col("text")).alias("text"))
