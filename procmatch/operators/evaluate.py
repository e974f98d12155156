"""Retrieval metrics over ranked results and graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES, MRR_AT, NDCG_AT = (1, 3, 5), 5, (3, 5)
METRICS = [*[f"p_at_{k}" for k in PLACES], *[f"r_at_{k}" for k in PLACES], "mrr", *[f"ndcg_at_{k}" for k in NDCG_AT]]


def judgements(gold: DataFrame, query: str = "id", relevance: str = "relevance") -> DataFrame:
    """``(query_id, doc_id, rel)`` of a map column."""
    return gold.select(F.col(query).alias("query_id"), F.explode(relevance).alias("doc_id", "rel"))


def gain(rel, rank):
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def per_query(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, mrr_at: int | None = MRR_AT) -> DataFrame:
    """``ranked``: ``(system, query_id, doc_id, rank)``. A row of metrics for each system and query; precision divides by k; without relevant documents all but that are 0.

    ``queries``: ``(query_id, ...)``; every one of them gets a row for each system, with its other columns.
    """
    good = qrels.where("rel > 0")
    # Gains depend on grades alone, so documents are counted by grade and only the first few of each grade are rows to sort.
    counts = good.groupBy("query_id", "rel").agg(F.count("*").alias("n"))
    first = counts.select("query_id", "rel", "n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(max(NDCG_AT))).cast("int"))).alias("j"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "j")
    ideal = first.withColumn("i", F.row_number().over(order)).groupBy("query_id").agg(F.sum(F.when(F.col("j") == 1, F.col("n"))).alias("n_rel"), *[F.sum(F.when(F.col("i") <= k, gain(F.col("rel"), F.col("i")))).alias(f"ideal_{k}") for k in NDCG_AT])
    hits = ranked.join(good, ["query_id", "doc_id"])
    first = F.max(1 / F.col("rank")) if mrr_at is None else F.max(F.when(F.col("rank") <= mrr_at, 1 / F.col("rank")))
    got = hits.groupBy("system", "query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h_{k}") for k in PLACES], first.alias("first"), *[F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank")))).alias(f"g_{k}") for k in NDCG_AT])
    all_ = queries.crossJoin(ranked.select("system").distinct()).join(got, ["system", "query_id"], "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.select(
        "system", *queries.columns, *[zero(F.col(f"h_{k}") / k).alias(f"p_at_{k}") for k in PLACES], *[zero(F.col(f"h_{k}") / F.col("n_rel")).alias(f"r_at_{k}") for k in PLACES],
        zero(F.col("first")).alias("mrr"), *[zero(F.col(f"g_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_at_{k}") for k in NDCG_AT],
    )


def by_system(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("system").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def by_group(metrics: DataFrame, group: str = "language") -> DataFrame:
    """Means of each system, over all (``ALL``) and for each group, in one pass."""
    rows = metrics.withColumn("_g", F.col(group)).rollup("system", "_g").agg(F.grouping("_g").alias("_all"), F.grouping("system").alias("_top"), F.count("*").alias("n_queries"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])
    return rows.where("_top = 0").select("system", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("_g").cast("string")).alias(group), "n_queries", *METRICS)


def agreement(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """One row: share of queries with the same first document, mean Jaccard overlap of the first k; percent."""
    lists = lambda x, n: x.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias(f"s{n}"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias(f"t{n}"))
    both = lists(a, 1).join(lists(b, 2), "query_id", "full_outer")
    none = F.array().cast(a.select(F.array("doc_id")).schema[0].dataType)
    s1, s2 = F.coalesce("s1", none), F.coalesce("s2", none)
    union = F.size(F.array_union(s1, s2))
    return both.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("t1") == F.col("t2"), 100.0).otherwise(0.0)), 2).alias("top1_agreement"), F.round(F.avg(F.when(union > 0, F.size(F.array_intersect(s1, s2)) / union * 100).otherwise(0.0)), 2).alias("mean_jaccard"))


def delta(means: DataFrame, baseline: str, candidate: str, metrics: list[str] | None = None) -> DataFrame:
    """``(metric, baseline, candidate, change)``."""
    names = metrics or METRICS
    long = means.where(F.col("system").isin(baseline, candidate)).select("system", F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in names]), F.array(*[F.col(m) for m in names]))).alias("metric", "value"))
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("system") == baseline, F.col("value"))).alias("baseline"), F.max(F.when(F.col("system") == candidate, F.col("value"))).alias("candidate"))
    return wide.withColumn("change", F.round(F.col("candidate") - F.col("baseline"), 4))


def compare_systems(systems: dict[str, DataFrame], most: int = 14) -> DataFrame:
    """Ranked results ``(query_id, doc_id, rank)`` of several systems as one table."""
    out = None
    for name, ranked in systems.items():
        part = ranked.where(F.col("rank") <= most).select(F.lit(name).alias("system"), "query_id", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out
