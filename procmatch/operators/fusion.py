"""Score fusion, reranking of a candidate pool, final ranking and its reasons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmatch.functions.text import blank, normalize_text, sigmoid, tokenize, tokens_of_normalized, words_of
from procmatch.sources.shared import stored

ALPHA, BETA, POOL = 0.6, 0.5, 10
CANDIDATE = "candidate certification requirement"


def scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def min_max(scores: DataFrame, score: str = "score", name: str = "norm") -> DataFrame:
    """Scores of a query from 0 to 1; equal ones are 1 if positive, else 0. All documents' rows are there.

    The limits, a row a query, are stored first, so that Spark knows their size and leaves the scores where they lie if they are few.
    """
    limits = stored(scores.groupBy("query_id").agg(F.min(score).alias("_low"), F.max(score).alias("_high")), "limits")
    return scores.join(limits, "query_id").withColumn(name, scaled(F.col(score), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def min_max_sparse(scores: DataFrame, n_docs: DataFrame, score: str = "score", name: str = "norm") -> DataFrame:
    """``min_max`` where documents without a row score 0 (and none below): their zeros needn't be there to be the minimum.

    ``n_docs``: one row (n), the number of documents.
    """
    limits = scores.groupBy("query_id").agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count("*").alias("_found")).join(F.broadcast(n_docs.select(F.col("n").alias("_n"))))
    low = F.when(F.col("_found") < F.col("_n"), F.least(F.lit(0.0), "_low")).otherwise(F.col("_low"))
    return scores.join(limits, "query_id").withColumn(name, scaled(F.col(score), low, F.greatest("_high", low))).drop("_low", "_high", "_found", "_n")


def fuse(lexical: DataFrame, semantic: DataFrame | None, n_docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Candidates ``(query_id, doc_id, bm25_raw, bm25_norm, semantic_raw, semantic_norm, relevance_score)`` of either side.

    Each side is scaled over all documents of a query; a document that one side lacks has 0 there. Outputs are
    rounded to 4 places, fusion takes what isn't rounded. Both sides lie by the same keys, so the join adds no shuffle to the sums'.
    Without a semantic side there is no join.
    """
    lex = min_max_sparse(lexical, n_docs).select("query_id", "doc_id", F.col("score").alias("b"), F.col("norm").alias("bn"))
    sem = None if semantic is None else min_max_sparse(semantic, n_docs).select("query_id", "doc_id", F.col("score").alias("s"), F.col("norm").alias("sn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = lex.withColumns({"s": F.lit(0.0), "sn": F.lit(0.0)}) if sem is None else lex.join(sem, ["query_id", "doc_id"], "full_outer")
    r4 = lambda c: F.round(c, 4)
    return both.select("query_id", "doc_id", r4(zero("b")).alias("bm25_raw"), r4(zero("bn")).alias("bm25_norm"), r4(zero("s")).alias("semantic_raw"), r4(zero("sn")).alias("semantic_norm"), r4(alpha * zero("sn") + (1 - alpha) * zero("bn")).alias("relevance_score"))


def overlap_scorer() -> Callable[[list[str], list[str]], list[float]]:
    """The default pair scorer: a logit of the share of the query's words that the text has."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = set(q.lower().split()), set(t.lower().split())
            out.append(8 * len(a & b) / len(a) - 4 if a else -4.0)
        return out

    return score


def pair_scores(pairs: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]] = overlap_scorer, query: str = "query", text: str = "candidate_text", name: str = "cross_encoder_raw") -> DataFrame:
    """A score for each pair from the user's scorer, made once in a task."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = scorer()
        for q, t in batches:
            yield pd.Series(own(q.fillna("").tolist(), t.fillna("").tolist()), dtype=float)

    return pairs.withColumn(name, run(F.col(query), F.col(text)))


def with_pool(candidates: DataFrame, pool: int = POOL, order: str = "doc_id", k: int | None = None) -> DataFrame:
    """``hybrid_rank`` by relevance, and whether the row is in the pool.

    With ``k`` only rows that can come among the k best are kept: the pool and the k next, since reranking moves no others. Spark
    drops the rest of a query's rows in each task before it shuffles them.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), order)
    ranked = candidates.withColumn("hybrid_rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("hybrid_rank") <= pool + max(1, k))
    return ranked.withColumn("in_pool", F.col("hybrid_rank") <= pool)


def rerank(candidates: DataFrame, raw: DataFrame | None, beta: float = BETA) -> DataFrame:
    """Pool rows get ``round(beta * sigmoid(raw) + (1 - beta) * hybrid, 4)``; others and, without scores, all stay as they are.

    ``candidates`` has ``hybrid_rank`` and ``in_pool``; ``raw``: ``(query_id, doc_id, cross_encoder_raw)`` of pool rows.
    """
    hybrid = F.round("relevance_score", 4)
    if raw is None:
        none = F.lit(None).cast("double")
        return candidates.withColumns({"hybrid_score": hybrid, "cross_encoder_raw": none, "cross_encoder_norm": none, "reranked": F.lit(False)})
    both = candidates.join(raw.select("query_id", "doc_id", F.col("cross_encoder_raw").alias("_raw")), ["query_id", "doc_id"], "left")
    scored = F.col("in_pool") & F.col("_raw").isNotNull()
    norm = sigmoid(F.col("_raw"))
    new = F.when(scored, F.round(beta * norm + (1 - beta) * F.col("relevance_score"), 4)).otherwise(F.col("relevance_score"))
    return both.withColumns({"hybrid_score": hybrid, "cross_encoder_raw": F.when(scored, F.round("_raw", 4)), "cross_encoder_norm": F.when(scored, F.round(norm, 4)), "reranked": scored, "relevance_score": new}).drop("_raw")


def final_top_k(candidates: DataFrame, k: int = 5, order: list | None = None) -> DataFrame:
    """The k best (at least 1) of each query with ``rank`` and ``relative_match_score``, a share of the best score in whole percent, ties to even."""
    best = order or [F.desc("relevance_score"), *([F.desc("reranked"), "hybrid_rank"] if "reranked" in candidates.columns else []), "doc_id"]
    w = Window.partitionBy("query_id").orderBy(*best)
    top = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))
    high = F.max("relevance_score").over(Window.partitionBy("query_id"))
    return top.withColumn("relative_match_score", F.when(high > 1e-9, F.bround(F.col("relevance_score") / high * 100, 0)).otherwise(0.0))


def matched_keywords(keywords: Column, query_norm: Column, query_tokens: Column) -> Column:
    """Keywords, lower case, that the query holds or that hold one of its words."""
    low = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(k))
    return F.filter(low, lambda k: F.contains(query_norm, k) | F.exists(query_tokens, lambda t: F.contains(k, t)))


def reasons(query: Column) -> Column:
    """Why a row was found, from its columns: category or sector, keywords, scope, score, version, certification.

    Words in common are listed in alphabetical order.
    """
    norm = normalize_text(query)
    tokens = F.array_distinct(tokens_of_normalized(norm))
    common = lambda c: F.array_sort(F.array_intersect(tokens, tokenize(F.col(c))))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    listed = lambda a, n=None: F.array_join(F.slice(a, 1, n) if n else a, ", ")
    keywords = matched_keywords(F.col("keywords"), norm, tokens)
    said = [
        F.when(F.size(common("product_category")) > 0, say("Product category match: '", F.col("product_category"), "' (matched '", listed(common("product_category")), "')")).when(F.size(common("sector")) > 0, say("Engineering sector alignment: '", F.col("sector"), "'")),
        F.when(F.size(keywords) > 0, say("Matched standard keywords: ", listed(keywords, 3))),
        F.when(F.size(common("scope")) >= 2, say("High technical scope overlap on terms: ", listed(common("scope"), 3))),
        F.when(F.col("reranked") & F.col("cross_encoder_norm").isNotNull(), say("Cross-encoder deep relevance score: ", F.format_string("%.2f", F.col("cross_encoder_norm"))))
        .when(F.col("semantic_raw") >= 0.5, say("Strong semantic vector contextual similarity (", F.floor(F.col("semantic_raw") * 100), "%)"))
        .when(F.col("bm25_norm") >= 0.5, say("Strong lexical keyword match density (BM25 normalized score: ", F.col("bm25_norm"), ")")),
        F.when(F.col("has_amendments"), say("Version status: ", F.col("version_status"), " (Latest: Amd #", blank_as_none(F.col("latest_number")), ", ", blank_as_none(F.col("latest_year")), ")")).when(F.coalesce(F.col("revision_year"), F.lit(0)) != 0, say("Revision year: ", F.col("revision_year"), " (", F.col("version_status"), ")")),
        F.when(F.col("indication") == CANDIDATE, say("Certification scheme: ", blank(F.col("certification_scheme")), " (candidate requirement in prototype rules)")),
    ]
    got = F.array_compact(F.array(*said))
    return F.when(F.size(got) > 0, got).otherwise(words_of(["General semantic & technical scope relevance match"]))


def blank_as_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))
