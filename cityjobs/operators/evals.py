"""Conversations: verdicts, boards, budgets, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .urls import fresh

VERDICT = "struct<scores:map<string,double>,rationale:map<string,string>,patterns:array<string>,connector_gap:string,kb_gap:string>"


def parse_verdicts(df: DataFrame, raw: str) -> DataFrame:
    """Adds verdict and error: judge_no_json, judge_bad_json or null."""
    span = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.nullif(span, F.lit("")), VERDICT)
    bad = parsed.isNull() | F.try_variant_get(F.try_parse_json(span), "$", "variant").isNull()
    error = F.when(F.coalesce(span, F.lit("")) == "", "judge_no_json").when(bad, "judge_bad_json")
    return df.withColumn("error", error).withColumn("verdict", F.when(error.isNull(), parsed))


def axis_scores(results: DataFrame) -> DataFrame:
    """(axis, score): the mean of each axis, rounded to 2."""
    return results.select(F.explode("scores").alias("axis", "v")).groupBy("axis").agg(F.round(F.avg("v"), 2).alias("score"))


def persona_scores(results: DataFrame, axes: list[str]) -> DataFrame:
    rows = results.select("persona_id", F.explode("scores").alias("axis", "v"))
    return rows.groupBy("persona_id").pivot("axis", axes).agg(F.round(F.avg("v"), 2))


def pattern_counts(results: DataFrame) -> DataFrame:
    return results.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern")


def gap_list(results: DataFrame, gap: str = "kb_gap", n: int = 20) -> DataFrame:
    """(conv_id, gap) of the first n conversations that name a gap."""
    return results.where(F.col(gap).isNotNull() & (F.lower(gap) != "null") & (gap_text(gap) != "")).select("conv_id", F.col(gap).alias("gap")).orderBy("conv_id").limit(n)


def gap_text(gap: str) -> Column:
    return F.trim(F.coalesce(gap, F.lit("")))


def gap_counts(results: DataFrame, gap: str = "connector_gap") -> DataFrame:
    """Null and the text 'null' mean no gap."""
    return results.where(F.col(gap).isNotNull() & (F.lower(gap) != "null")).groupBy(gap).agg(F.count("*").alias("n")).orderBy(F.desc("n"), gap)


def worst_conversations(results: DataFrame, n: int, missing: str = "last") -> DataFrame:
    """The n lowest total scores; without scores last (999) or first (0)."""
    total = F.when(F.coalesce(F.size("scores"), F.lit(0)) > 0, F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).otherwise(999.0 if missing == "last" else 0.0)
    return results.withColumn("total", F.round(total, 2)).orderBy("total", "conv_id").limit(n)


def render_transcript(turns: DataFrame, cut: int = 1200, max_turns: int | None = None) -> DataFrame:
    """(conv_id, transcript): '[ROLE i] text' by turn, each text cut; of the first max_turns turns."""
    rows = turns.withColumn("i", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    rows = rows.where(F.col("i") < max_turns) if max_turns else rows
    line = F.concat(F.lit("["), F.upper("role"), F.lit(" "), F.col("i"), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, cut))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("i"), line.alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("transcript"))


def latency_stats(results: DataFrame) -> DataFrame:
    mean = F.aggregate("latencies_s", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("latencies_s"), F.lit(0))
    return results.select("conv_id", F.round(mean, 3).alias("mean_latency"))


def regression_check(scores: DataFrame, baseline: DataFrame, axis_drop: float = 0.5, persona_drop: float = 3.0) -> DataFrame:
    """(kind, name, delta) of axes and personas that fell too far. Both tables: (persona_id, axis, score)."""

    def fell(key: str, agg: Column, limit: float) -> DataFrame:
        now, then = scores.groupBy(key).agg(agg.alias("now")), baseline.groupBy(key).agg(agg.alias("then"))
        return now.join(then, key).select(F.lit(key).alias("kind"), F.col(key).alias("name"), F.round(F.col("now") - F.col("then"), 2).alias("delta")).where(F.col("delta") < -limit)

    return fell("axis", F.avg("score"), axis_drop).unionByName(fell("persona_id", F.sum("score"), persona_drop))


#: Words that tell a language; the dialect's count as German.
LANGUAGE_WORDS = {
    "de": "der die das und ist nicht ich ein eine mit für auf wie wo was isch nöd chunt hät gits wänn öppis".split(),
    "en": "the and is not of to in with for on how where what are you can please".split(),
    "fr": "le la les et est pas de des une avec pour sur comment où quoi vous".split(),
    "it": "il lo gli e è non di del una con per su come dove cosa sono".split(),
}


def language_of(text: Column) -> Column:
    """The language most of whose words a text has; null without any. Ties go to the first."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "), " ")
    counts = [F.size(F.filter(words, lambda w: w.isin(own))) for own in LANGUAGE_WORDS.values()]  # noqa: B023 (called at once)
    most = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for lang, n in reversed(list(zip(LANGUAGE_WORDS, counts))):
        out = F.when((n == most) & (most > 0), F.lit(lang)).otherwise(out)
    return out


def hard_checks(replies: DataFrame, realtime_tools: list[str], connectors: list[str] = ()) -> DataFrame:
    """replies: question, reply, called, expected, forbidden (arrays of tool names).

    A citation is '[Quelle:', a markdown link or a connector's name. Languages match unless both are told and differ.
    """
    claims = F.col("reply").rlike(r"(?i)\b(right now|currently|aktuell|jetzt)\b")
    cited = F.col("reply").rlike(r"\[Quelle:|\[[^\]]+\]\([^)\s]+\)")
    for name in connectors:
        cited = cited | F.lower("reply").contains(name.lower())
    return replies.withColumns(
        {
            "language_ok": F.coalesce(language_of(F.col("question")) == language_of(F.col("reply")), F.lit(True)),
            "has_citations": cited,
            "length_ok": F.length("reply") <= 2000,
            "tools_ok": (F.size(F.array_except("expected", "called")) == 0) & ~F.arrays_overlap("called", "forbidden"),
            "realtime_ok": ~claims | F.arrays_overlap("called", F.array(*map(F.lit, realtime_tools))),
        }
    )


def truncate_history(turns: DataFrame, budget: int = 2000) -> DataFrame:
    """The newest turns within the budget; system turns and the newest one always stay. turns: conv_id, turn, role, tokens."""
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    counted = F.when(F.col("role") == "system", 0).otherwise(F.col("tokens"))
    running = F.sum(counted).over(newest.rowsBetween(W.unboundedPreceding, 0))
    place = fresh(turns, "_n")
    rows = turns.withColumn("running", running).withColumn(place, F.row_number().over(newest))
    return rows.where((F.col("running") <= budget) | (F.col("role") == "system") | (F.col(place) == 1)).drop(place)


def conversation_cap(turns: DataFrame, cap: int = 50_000) -> DataFrame:
    running = F.sum("tokens").over(W.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("running", running).withColumn("over_cap", F.col("running") > cap)


def turn_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """prices: (model, price_in, price_out) per million tokens, one row a model."""
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1_000_000
    return usage.join(prices, "model", "left").withColumn("cost", cost)


def cost_rollup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by month, day and conversation, with subtotals."""
    rows = turn_cost(usage, prices).withColumn("month", F.date_format("day", "yyyy-MM")).withColumn("date", F.date_format("day", "yyyy-MM-dd"))
    return rows.rollup("month", "date", "conv_id").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("turns"))


def scrub_pii(text: Column) -> Column:
    """E-mail addresses, telephone numbers and IBANs masked.

    An address is looked for once in each run of letters, from its beginning and without going back: in linear time.
    """
    text = F.regexp_replace(text, r"(?<![^@\s])[^@\s]++@[^@\s]+\.[^@\s]+", "[email]")
    text = F.regexp_replace(text, r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[iban]")
    return F.regexp_replace(text, r"\+?\d[\d ()/-]{7,}\d", "[phone]")
