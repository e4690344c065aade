"""Batch retrieval: many queries against many vectors or chunks, with citations and budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import meet
from .chunks import count_tokens, split_sentences
from .urls import keep_checkpoints, trimmed

#: The inverted file: cells at most, rows that centroids are fitted on, of those for each cell, rounds of the fit.
CELLS, FIT_ROWS, FIT_ROWS_A_CELL, FIT_ROUNDS = 1_024, 65_536, 32, 4
FOUND = "query_id long, vec_id long, distance double"


def wrap_document(text: Column) -> Column:
    return F.concat(F.lit("title: none | text: "), text)


def wrap_query(text: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), text)


def embed(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], name: str = "embedding") -> DataFrame:
    """Adds L2-normalised vectors of a pluggable encoder, one batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            v = np.asarray(encoder(texts.fillna("").tolist()), np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v))

    return df.withColumn(name, run(F.col(text)))


def matrix_of(column: pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """Lists of equal size as the rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1 if len(column) else 0)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def best_of(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance) of the k least (distance, id) in each row of d, ids by column."""
    if d.shape[1] > k:
        # what is no farther than the kth, ties included, is sorted; the rest is not
        row, column = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, column = [x.ravel() for x in np.indices(d.shape)]
    far, own = d[row, column], ids[column]
    order = np.lexsort((own, far, row))
    row, far, own = row[order], far[order], own[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[keep], own[keep], far[keep]


def centroids_of(vectors: DataFrame) -> np.ndarray:
    """Unit centroids of at most CELLS cells, fitted by a few rounds of k-means on the FIT_ROWS rows of least hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow()
    v = unit(matrix_of(rows.column("embedding")))
    n = min(CELLS, len(v) // FIT_ROWS_A_CELL)
    if n < 2:
        return v[:1]
    centres = v[:n]
    for _ in range(FIT_ROUNDS):
        own = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, sums, centres)
        centres = unit(centres)
    return centres


def in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds `cell`, the nearest centre, and `far`, the Euclidean distance from it, of the unit vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # at most CELLS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value @ unit(matrix_of(pa.chunked_array([batch.column("embedding")]))).T if len(batch) else np.zeros((1, 0))
            far = np.sqrt(np.maximum(0, 2 - 2 * found.max(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.argmax(0).astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{fields}, cell int, far double")


def knn_topk(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the k nearest by cosine distance, rounded to 4.

    An inverted file: every vector lies in the cell of its nearest centroid, and a cell knows its radius. A query
    first meets the nearest cells that hold k vectors, which bounds its kth distance, then those of the other cells that
    the triangle inequality doesn't rule out. So the answer is exact, whatever the centroids, which are fitted on a
    bounded sample. Queries (query_id, embedding) and vectors meet in joins of bounded groups; nothing is looped over or
    gathered but the centroids and a row for each cell. Distances tie by vec_id. Null and zero vectors match nothing.
    """
    spark = queries.sparkSession
    keep_checkpoints(spark)
    filled = F.exists("embedding", lambda x: x != 0)
    vectors = (vectors if where is None else vectors.where(where)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(filled)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(filled)
    centres = centroids_of(vectors)
    if not len(centres):
        return spark.createDataFrame([], FOUND).withColumn("rank", F.lit(1))
    rows = in_cells(vectors, centres).checkpoint()
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas().set_index("cell").reindex(range(len(centres)))
    size, radius = cells["n"].fillna(0).to_numpy(), cells["radius"].fillna(-1).to_numpy()
    sent = spark.sparkContext.broadcast((centres, size, radius))

    def visits(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, size, radius = sent.value
            for batch in batches:
                if not len(batch):
                    continue
                d = np.sqrt(np.maximum(0, 2 - 2 * unit(matrix_of(pa.chunked_array([batch.column("embedding")]))) @ centres.T))
                order = np.argsort(np.where(size > 0, d, np.inf), axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                home = np.zeros(d.shape, bool)
                np.put_along_axis(home, order, before < k, axis=1)  # the nearest cells up to k vectors
                home &= size > 0
                if not first:
                    kth = batch.column("kth").to_numpy(zero_copy_only=False)
                    # kth is rounded to 4: what rounds to the same may lie half of 1e-4 beyond it, and as much before
                    reach = np.sqrt(2 * np.maximum(0, np.where(np.isnan(kth), 3, kth) + 1.01e-4)) + 1e-6
                    home = ~home & (size > 0) & (d - radius <= reach[:, None])
                row, cell = np.nonzero(home)
                taken = batch.select(["query_id", "embedding"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *taken.columns], names=["cell", "query_id", "embedding"])

        return run

    def near(rows: pa.Table, probes: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        d = np.round(1 - unit(matrix_of(probes.column("embedding"))) @ unit(matrix_of(rows.column("embedding"))).T, 4) + 0.0
        row, own, far = best_of(d, ids, k)
        return pa.table({"query_id": probes.column("query_id").to_numpy()[row], "vec_id": own, "distance": far})

    def search(probes: DataFrame) -> DataFrame:
        return meet(rows.select("cell", "vec_id", "embedding"), "vec_id", probes, "query_id", near, FOUND)

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    place = "cell int, query_id long, embedding array<float>"
    at_home = best(search(asked.mapInArrow(visits(True), place).checkpoint())).checkpoint()
    kth = at_home.where(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
    beyond = search(asked.join(kth, "query_id", "left").mapInArrow(visits(False), place).checkpoint())
    return best(at_home.drop("rank").unionByName(beyond))


def cite_sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources): distinct source names in rank order, with a url where that is not blank or local."""
    url = F.when((F.trim("source_url") != "") & ~F.col("source_url").startswith("local://"), F.col("source_url"))
    first = hits.groupBy("query_id", "source_name").agg(F.min("rank").alias("rank"), F.min_by(url, "rank").alias("url"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source_name", "url")))
    return first.groupBy("query_id").agg(F.transform(ordered, lambda x: F.concat_ws(" ", x["source_name"], x["url"])).alias("sources"))


#: What a question may call a law, and what the law's name holds. The first that a question has counts.
LAW_NAMES = {
    "or": "OBLIGATIONENRECHT", "obligationenrecht": "OBLIGATIONENRECHT", "zgb": "ZIVILGESETZBUCH", "zivilgesetzbuch": "ZIVILGESETZBUCH", "bv": "BUNDESVERFASSUNG", "bundesverfassung": "BUNDESVERFASSUNG",
    "stgb": "STRAFGESETZBUCH", "strafgesetzbuch": "STRAFGESETZBUCH", "stpo": "STRAFPROZESSORDNUNG", "strafprozessordnung": "STRAFPROZESSORDNUNG", "zpo": "ZIVILPROZESSORDNUNG", "zivilprozessordnung": "ZIVILPROZESSORDNUNG",
    "vrv": "VRV", "verkehrsregeln": "VRV",
}


def parse_law_query(text: Column, laws: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(article_no, law): the number after Art., Artikel or §; what the first listed law that is a word of the text is called."""
    number = F.nullif(F.lower(F.regexp_extract(text, r"(?i)(?:art(?:ikel)?\.?\s*|§\s*)(\d+[a-z]?)\b", 1)), F.lit(""))
    law = F.lit(None).cast("string")
    for word, name in reversed((LAW_NAMES if laws is None else laws).items()):
        law = F.when(F.lower(text).rlike(rf"\b{word}\b"), F.lit(name)).otherwise(law)
    return number, law


def article_numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bart\.\s*(\d+[a-z]?)\b"), 1), F.lower))


def law_article_lookup(queries: DataFrame, chunks: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks that name the query's article, of the law it names if any; score 1.0,
    the first k by chunk_id. Of those k only the ones that `keep` holds for come out.

    As only the first k count, each (article, law name) keeps its first k chunks before anything is joined. Each
    distinct question (article, law) is answered once, and the answers, at most k each, are joined with the queries.
    """
    kept = F.lit(True) if keep is None else keep
    named = chunks.select("chunk_id", "law_name", kept.alias("_keep"), F.explode(article_numbers(F.col("display_text"))).alias("article_no"))
    first = named.withColumn("_n", F.row_number().over(W.partitionBy("article_no", "law_name").orderBy("chunk_id"))).where(F.col("_n") <= k)
    asked = queries.where("article_no is not null").select("article_no", F.coalesce("law", F.lit("")).alias("_law"))
    both = asked.distinct().join(first, "article_no").where((F.col("_law") == "") | F.contains(F.upper(F.coalesce("law_name", F.lit(""))), F.col("_law")))
    rank = F.row_number().over(W.partitionBy("article_no", "_law").orderBy("chunk_id"))
    answers = both.withColumn("rank", rank).where((F.col("rank") <= k) & F.col("_keep")).select("article_no", "_law", "chunk_id", "rank")
    posed = queries.select("query_id", "article_no", F.coalesce("law", F.lit("")).alias("_law"))
    return posed.join(answers, ["article_no", "_law"]).select("query_id", "chunk_id", F.lit(1.0).alias("score"), "rank")


def is_noise_chunk(text: Column) -> Column:
    """Over four lines with few words or many footnotes."""
    lines = trimmed(F.split(text, "\n"))
    n = F.size(lines)
    words = F.aggregate(lines, F.lit(0), lambda a, x: a + F.size(F.split(x, r"\s+")))
    notes = F.size(F.filter(lines, lambda x: x.rlike(r"\d{3,}\s+AS \d{4}")))
    return F.coalesce((n > 4) & ((words < n * 5) | (notes > n * 0.3)), F.lit(False))


def law_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank, via): keyword hits without noise; queries left with none take the nearest k of
    five times k chunks by their vectors, without noise, with the distance as score.

    queries: query_id, article_no, law, embedding; vectors: (vec_id, embedding) of the chunks, by chunk_id. The keyword
    limit comes before the noise filter, the dense one after it.
    """
    keyword = law_article_lookup(queries, chunks, k, ~is_noise_chunk(F.col("display_text"))).withColumn("via", F.lit("keyword"))
    keep_checkpoints(queries.sparkSession)
    keyword = keyword.checkpoint()
    rest = queries.join(keyword.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "embedding")
    near = knn_topk(rest, vectors, 5 * k).withColumnRenamed("vec_id", "chunk_id")
    good = chunks.where(~is_noise_chunk(F.col("display_text"))).select("chunk_id")
    again = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    dense = near.join(good, "chunk_id", "left_semi").withColumn("rank", again).where(F.col("rank") <= k)
    return keyword.unionByName(dense.select("query_id", "chunk_id", F.col("distance").alias("score"), "rank", F.lit("dense").alias("via")))


def expand_to_parent(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits replaced by their parents where they have one; a chunk once a query, at its best rank."""
    parents = chunks.select("chunk_id", "parent_chunk_id")
    shown = hits.join(parents, "chunk_id", "left").select("query_id", F.coalesce("parent_chunk_id", "chunk_id").alias("chunk_id"), "rank")
    return shown.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))


def context_budget(hits: DataFrame, max_k: int, max_tokens: int) -> DataFrame:
    """The first max_k hits while their running token sum is within the budget.

    With a `text` column the hit that goes beyond it is cut after the last of its sentences that fits, if one does;
    token_count and running_tokens count what is left.
    """
    running = F.sum("token_count").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = hits.where(F.col("rank") <= max_k).withColumn("running_tokens", running)
    if "text" not in hits.columns:
        return rows.where(F.col("running_tokens") <= max_tokens)
    room = F.lit(max_tokens) - (F.col("running_tokens") - F.col("token_count"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("full"))

    def take(state: Column, sentence: Column) -> Column:
        n = state["n"] + count_tokens(sentence)
        full = state["full"] | (n > room)
        return F.struct(F.when(full, state["kept"]).otherwise(F.concat(state["kept"], F.array(sentence))).alias("kept"), F.when(full, state["n"]).otherwise(n).alias("n"), full.alias("full"))

    cut = F.when(F.col("running_tokens") > max_tokens, F.aggregate(split_sentences(F.col("text")), start, take))
    rows = rows.where(room > 0).withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.size("_cut.kept") > 0))
    whole = F.col("_cut").isNull()
    left = F.when(whole, F.col("token_count")).otherwise(F.col("_cut.n"))
    return rows.withColumns(
        {
            "text": F.when(whole, F.col("text")).otherwise(F.array_join("_cut.kept", " ")),
            "running_tokens": F.col("running_tokens") - F.col("token_count") + left,
            "token_count": left,
        }
    ).drop("_cut")


def flag_empty_retrieval(result: Column, phrases: tuple[str, ...] = ("no results", "keine ergebnisse", "not found")) -> Column:
    text = F.lower(F.coalesce(result, F.lit("")))
    out = F.trim(text) == ""
    for phrase in phrases:
        out = out | text.contains(phrase)
    return out
