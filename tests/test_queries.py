"""Every registered query against its SQL form; and the few without one."""

import pytest
from conftest import DATA, assert_same

from procmatch import catalog_queries, queries, source_queries  # noqa: F401  all register

NO_SQL = sorted(set(queries.QUERIES) - set(queries.ORACLES))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark, duck):
    assert_same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", NO_SQL)
def test_runs_and_repeats(name, spark):
    a = queries.QUERIES[name](spark, DATA)
    first = sorted(map(str, a.collect()))
    assert first and first == sorted(map(str, queries.QUERIES[name](spark, DATA).collect()))


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from procmatch.streaming.enrich import enrich_documents

    batch = enrich_documents(spark.read.parquet(f"{DATA}/documents.parquet"))
    batch = batch.select("doc_id", "n_normal", "n_tokens", "product.name", "product.category", F.size("technical_requirements").alias("n_attributes"), F.size("standards_mentions").alias("n_mentions"))
    assert sorted(map(str, batch.collect())) == sorted(map(str, queries.stream_enrich(spark, DATA).collect()))


def test_tfidf_against_brute_force(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from procmatch.functions.text import tokenize
    from procmatch.operators.dense import tfidf_vectors

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tokens = {r[0]: r[1] for r in docs.select("doc_id", tokenize(F.col("text"))).collect()}
    grams = {d: t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)] for d, t in tokens.items()}
    every = sorted({g for gs in grams.values() for g in gs})
    place = {r[0]: r[1] for r in spark.createDataFrame([(g,) for g in every], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(64)).cast("int")).collect()}
    counts = {d: Counter(place[g] for g in gs) for d, gs in grams.items()}
    df = Counter(p for c in counts.values() for p in c)
    got = {r["doc_id"]: r["embedding"] for r in tfidf_vectors(docs, 64).collect()}
    for d, c in counts.items():
        want = [c[i] * (math.log((len(counts) + 1) / (df[i] + 1)) + 1) if c[i] else 0.0 for i in range(64)]
        size = math.sqrt(sum(x * x for x in want)) or 1
        assert got[d] == pytest.approx([x / size for x in want], abs=1e-6)


def test_catalog_can_be_stored(spark, tmp_path):
    from procmatch.plans import pipelines

    built, asked = queries.catalog_without_inferred(spark, DATA), queries.requests(spark, DATA)
    built.save(f"file://{tmp_path}/catalog")
    loaded = pipelines.Catalog.load(spark, f"file://{tmp_path}/catalog")
    columns = ["query_id", "rank", "doc_id", "relevance_score", "reasons"]
    a, b = (sorted(map(str, pipelines.recommend(asked, c, 3).select(columns).collect())) for c in (built, loaded))
    assert a == b and len(a) == 3 * asked.count()


def test_unrelated_request_scores_low(spark):
    """Nothing in common: no candidates; little in common: the best is relative to itself."""
    from procmatch.plans import pipelines

    asked = spark.createDataFrame([(1, "office chair for employees"), (2, ""), (3, None)], "query_id long, query string")
    assert pipelines.recommend(asked, queries.catalog_without_inferred(spark, DATA), 5).count() == 0


def test_recommendations_repeat_and_stay_in_range(spark):
    rows = queries.recommend_from_requirements(spark, DATA).collect()
    assert rows and all(0 <= r["relevance_score"] <= 1 and 1 <= r["rank"] <= 3 for r in rows) and any(r["reranked"] for r in rows)
