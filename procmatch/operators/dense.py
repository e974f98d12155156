"""Vector functions and exact search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmatch.functions.text import blank, tokenize
from procmatch.operators import blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    size = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, 1.0).otherwise(n))[0]
    return F.transform(F.array(F.struct(v.alias("v"), size.alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def check_dimension(vectors: DataFrame, dimension: int, vector: str = "embedding", strict: bool = False) -> DataFrame:
    """With ``reject_reason``; or, if strict, the query fails at the first wrong vector."""
    bad = F.size(vector) != dimension
    if strict:
        return vectors.where(F.assert_true(~bad, F.lit("wrong vector dimension")).isNull())
    return vectors.withColumn("reject_reason", F.when(F.col(vector).isNull(), "missing").when(bad, "dimension_mismatch"))


def search_pairs(queries: DataFrame, docs: DataFrame, query: str = "query_id", doc: str = "doc_id", vector: str = "embedding", block: int = blocks.BLOCK) -> DataFrame:
    """Every pair's score, where all are wanted; without a query vector all its scores are 0."""
    return score_all(queries, docs, None, query, doc, vector, block, null_queries=True)


def _asked(queries: DataFrame, query: str, vector: str, null_queries: bool = False) -> DataFrame:
    q = queries if null_queries else queries.where(F.col(vector).isNotNull())
    return q.select(F.col(query).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))


def score_all(queries: DataFrame, docs: DataFrame, k: int | None = None, query: str = "query_id", doc: str = "doc_id", vector: str = "embedding", block: int = blocks.BLOCK, null_queries: bool = False) -> DataFrame:
    """``(query_id, doc_id, score)``: cosines cut to 0..1, of all pairs or of each task's ``k`` best a query.

    A slice of documents is one matrix product with a block of queries. Scores are rounded to 12
    places, so that equal vectors tie. Null query vectors have no rows, null documents' neither; zero vectors score 0.
    """
    return nearest(queries, docs, k, [doc], query, vector, block, null_queries).withColumnRenamed(doc, "doc_id")


def nearest(queries: DataFrame, docs: DataFrame, k: int | None, keys: list[str], query: str = "query_id", vector: str = "embedding", block: int = blocks.BLOCK, null_queries: bool = False) -> DataFrame:
    """``(query_id, *keys, score)`` as ``score_all``, for documents with several key columns, by which ties are ordered.

    With ``k`` a slice of documents is passed over for those queries that, by its centre and radius, none of it can bring among the task's k best so far;
    ``clustered`` lays documents so that radii are small.
    """
    q = _asked(queries, query, vector, null_queries)
    types = {c: docs.schema[c].dataType.simpleString() for c in keys}
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", score double"
    slim = docs.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    return blocks.product(q, slim, Nearest(k, keys), schema, block)


#: What single precision changes in a cosine, and more.
SINGLE = 1e-5


class Nearest:
    """What a task does with a block of queries and its documents; ``scored`` counts the pairs worked out."""

    def __init__(self, k: int | None, keys: list[str]):
        self.k, self.keys, self.scored = k, keys, 0

    def __call__(self, queries: pa.Table) -> Callable[[blocks.Batches], blocks.Batches]:
        ids = queries.column("query_id").combine_chunks()
        m, _ = blocks.unit_vectors(queries.column("v"))

        def run(batches: blocks.Batches) -> blocks.Batches:
            best = blocks.Best(len(ids), self.k, self.keys) if self.k is not None else None
            names, single = ["query_id", *self.keys, "score"], m.astype(np.float32)
            for batch in blocks.sliced(batches, len(ids)):
                if not batch.num_rows or not len(ids):
                    continue
                batch = blocks.in_order(batch, self.keys) if best else batch
                v, _ = blocks.unit_vectors(batch.column(len(self.keys)))
                queries, rough = (m, single) if m.shape[1] else (np.zeros((len(m), v.shape[1])), np.zeros((len(m), v.shape[1]), np.float32))
                live = np.arange(len(ids)) if best is None else np.flatnonzero(np.maximum(blocks.reach(queries, v), 0) >= best.least)
                self.scored += len(live) * len(v)
                if not len(live):
                    continue
                if best is None:
                    near = np.round(np.clip(queries[live] @ v.T, 0, 1), 12)
                    q, d = np.repeat(live, len(v)), np.tile(np.arange(len(v)), len(live))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *[batch.column(i).take(pa.array(d)) for i in range(len(self.keys))], pa.array(near.ravel())], names=names)
                else:
                    # Single precision tells what can't be among the best.
                    near = np.clip(rough[live] @ v.astype(np.float32).T, 0, 1)
                    q, d = blocks.promising(near, self.k, best.least[live], SINGLE, np.full(len(live), -np.inf))
                    score = np.round(np.clip(np.einsum("ij,ij->i", queries[live[q]], v[d]), 0, 1), 12)
                    ok = score >= best.least[live[q]]
                    if ok.any():
                        best.add(live[q[ok]], score[ok], {c: batch.column(i).take(pa.array(d[ok])) for i, c in enumerate(self.keys)})
            if best is not None and best.rows is not None:
                yield from best.rows.select(["_q", *self.keys, "_score"]).set_column(0, "query_id", ids.take(best.rows.column("_q").combine_chunks())).rename_columns(names).to_batches()

        return run


def clustered(docs: DataFrame, vector: str = "embedding", clusters: int = 256, name: str = "cluster") -> DataFrame:
    """``docs`` with the number of the nearest of at most ``clusters`` documents drawn by hash, laid by it: documents near each other lie together.

    The drawn vectors are a sample of bounded size; whatever it is, searches stay exact, and only how much they pass over depends on it.
    """
    key = F.xxhash64(F.col(vector).cast("array<double>"))
    drawn = docs.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), key.alias("h")).orderBy("h").limit(clusters).select("v").toArrow()
    centres, _ = blocks.unit_vectors(drawn.column("v"))
    shared = docs.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def number(vectors: pd.Series) -> pd.Series:
        c, out = shared.value, np.zeros(len(vectors), np.int32)
        full = vectors.notna().to_numpy()
        if full.any() and len(c):
            out[full] = (np.stack(vectors[full].to_numpy()).astype(float) @ c.T).argmax(1)
        return pd.Series(out)

    return docs.withColumn(name, number(F.col(vector))).repartitionByRange(name).sortWithinPartitions(name)


def search(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", vector: str = "embedding", block: int = blocks.BLOCK) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the k most similar documents of each query, exactly; ties go to the smaller document id.

    Each task hands on its k best, and a window picks among those.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return score_all(queries, docs, k, query, doc, vector, block).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_chunks(queries: DataFrame, chunks: DataFrame, model: str | None = None, dimension: int | None = None, k: int | None = None, parent: str = "standard_id", query: str = "query_id", vector: str = "embedding", chunk: str = "chunk_id", block: int = blocks.BLOCK) -> DataFrame:
    """``(query_id, doc_id, score)``: the best chunk of each document; with ``k`` only a query's k best chunks are looked at."""
    if model is not None:
        chunks = chunks.where(F.col("embedding_model") == model)
    if dimension is not None:
        chunks = chunks.where(F.col("embedding_dimension") == dimension)
    pairs = nearest(queries, chunks, k, [parent, chunk], query, vector, block, null_queries=True)
    if k is not None:
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), parent, chunk))).where(F.col("rank") <= k)
    return pairs.groupBy("query_id", F.col(parent).alias("doc_id")).agg(F.max("score").alias("score"))


def semantic_status(vector: Column) -> Column:
    """Without a query vector all semantic scores are 0 and the status says so."""
    return F.when(vector.isNull(), "fallback_bm25").otherwise("active")


def encode(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", prefix: str = "", dimension: int = 384, name: str = "embedding") -> DataFrame:
    """A vector column from the user's encoder, made once in a task; blank texts get zero vectors, all others length 1. Vectors are of single precision, as the table's are.

    ``prefix`` is what some models want before a text ("query: ", "passage: ").
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder()
        for batch in batches:
            texts = batch.fillna("").str.strip()
            out = np.zeros((len(texts), dimension), np.float32)
            full = (texts != "").to_numpy()
            if full.any():
                v = np.asarray(own([prefix + t for t in texts[full]]), float)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                out[full] = v / np.where(size == 0, 1, size)
            yield pd.Series(list(out))

    return texts.withColumn(name, run(F.col(text)))


def tfidf_vectors(docs: DataFrame, dimension: int = 384, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, embedding)``: words and word pairs hashed to ``dimension`` places, smoothed idf, length 1; without a model."""
    ts = docs.select(doc, tokenize(blank(F.col(text))).alias("t"))
    n = F.size("t")
    grams = F.concat("t", F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get("t", i), F.get("t", i + 1)))).otherwise(F.array().cast("array<string>")))
    counts = ts.select(doc, F.explode(grams).alias("g")).select(doc, F.pmod(F.xxhash64("g"), F.lit(dimension)).cast("int").alias("at")).groupBy(doc, "at").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count("*").alias("n"))
    idf = counts.groupBy("at").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("at", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighed = counts.join(F.broadcast(idf), "at").groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("tf") * F.col("idf")))).alias("m"))
    filled = docs.select(doc).join(weighed, doc, "left")
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))
    dense = F.transform(F.array(F.coalesce("m", empty)), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(m[i], F.lit(0.0))))[0]
    return filled.select(doc, dense.alias("v")).select(doc, l2_normalize(F.col("v")).cast("array<float>").alias("embedding"))
