"""Search without all pairs: hybrid, vectors, impact-ordered postings, containment; against brute force, and in one scan of dealt blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from procmatch.operators import blocks, containment, dense, fusion, hybrid, impact, lexical, network
from procmatch.plans import pipelines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, rng, n, dimension=6):
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i:03d}", [words[min(int(rng.expovariate(0.1)), 39)] for _ in range(rng.randint(0, 12))], None if i % 11 == 0 else [rng.gauss(0, 1) for _ in range(dimension)]) for i in range(n)]
    return spark.createDataFrame(rows + [("zero", ["w1"], [0.0] * dimension), ("none", None, None)], "doc_id string, tokens array<string>, embedding array<double>")


def questions(spark, rng, n, dimension=6):
    rows = [(i, [f"w{rng.randint(0, 45)}" for _ in range(rng.randint(0, 5))], None if i % 5 == 0 else [rng.gauss(0, 1) for _ in range(dimension)]) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, tokens array<string>, embedding array<double>")


@pytest.mark.parametrize("block", [None, 4])
def test_hybrid_is_the_fusion_of_all_pairs(spark, block, monkeypatch):
    rng = random.Random(3)
    docs, asked = documents(spark, rng, 90).cache(), questions(spark, rng, 14).cache()
    monkeypatch.setattr(blocks, "CELLS", 200)  # many slices a task
    index = lexical.build_index(docs)
    got = fusion.final_top_k(hybrid.candidates(asked, docs, index, 7, block=block), 7)
    every = fusion.fuse(lexical.score(index, asked), dense.score_all(asked, docs), index.stats.select("n"))
    want = fusion.final_top_k(every, 7)
    plain = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["relevance_score"], 3), round(r["bm25_raw"], 3), round(r["semantic_norm"], 3)) for r in df.collect())
    assert plain(got) == plain(want) and got.count() > 14


def test_hybrid_hands_on_k_rows_a_task(spark):
    rng = random.Random(4)
    docs, asked = documents(spark, rng, 300).repartition(3), questions(spark, rng, 9)
    rows = hybrid.candidates(asked, docs, lexical.build_index(docs), 2)
    assert rows.count() <= 3 * 9 * 2 and "CartesianProduct" not in plan_of(rows)


def test_slices_out_of_reach_are_passed_over():
    """Documents around two opposite centres: a query near one never meets the other's, once it has its k."""
    rng = np.random.default_rng(0)
    near, far = (np.array([s, 0, 0, 0]) + rng.normal(0, 0.05, (2000, 4)) for s in (1.0, -1.0))
    batch = lambda v, at: pa.RecordBatch.from_arrays([pa.array(range(at, at + len(v))), pa.array(list(v), pa.list_(pa.float64()))], names=["doc_id", "_v"])
    cell = dense.Nearest(5, ["doc_id"])
    run = cell(pa.table({"query_id": [1], "v": [[1.0, 0.1, 0, 0]]}))
    got = pa.Table.from_batches(list(run(iter([batch(near, 0), batch(far, 2000), batch(far, 4000)]))))
    assert cell.scored == 2000 and got.num_rows == 5
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    scores = np.round(np.clip(unit @ (np.array([1.0, 0.1, 0, 0]) / np.hypot(1, 0.1)), 0, 1), 12)
    assert got.column("doc_id").to_pylist() == np.lexsort((np.arange(2000), -scores))[:5].tolist()


@pytest.mark.parametrize("block", [blocks.BLOCK, 3])
def test_vector_search_is_exact_for_any_number_of_queries(spark, block):
    rng = random.Random(5)
    docs, asked = documents(spark, rng, 120), questions(spark, rng, 20)
    laid = dense.clustered(docs, clusters=5)
    want = {}
    rows = [(r["doc_id"], np.array(r["embedding"])) for r in docs.collect() if r["embedding"]]
    for q in asked.collect():
        if q["embedding"]:
            v = np.array(q["embedding"]) / np.linalg.norm(q["embedding"])
            scored = sorted((-round(max(0.0, min(1.0, float(v @ (d / (np.linalg.norm(d) or 1))))), 9), i) for i, d in rows)
            want[q["query_id"]] = [i for _, i in scored[:4]]
    for table in (docs, laid):
        got = {}
        for r in dense.search(asked, table, 4, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want
    assert "CartesianProduct" not in plan_of(dense.search(asked, laid, 4, block=block))


def test_chunks_give_their_documents_best(spark):
    chunks = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 3, [0.7, 0.7]), ("c", 4, None)], "standard_id string, chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    rows = {(r["query_id"], r["doc_id"]): round(r["score"], 4) for r in dense.search_chunks(asked, chunks).collect()}
    assert rows == {(1, "a"): 1.0, (1, "b"): 0.7071, (2, "a"): 0.0, (2, "b"): 0.0}
    assert {r["doc_id"] for r in dense.search_chunks(asked.where("query_id = 1"), chunks, k=1).collect()} == {"a"}


def test_best_by_impact_against_all_postings():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n, k, lists, full = int(rng.integers(5, 300)), int(rng.integers(1, 12)), [], None
        full = np.zeros(n)
        for _ in range(int(rng.integers(1, 14))):
            m = int(rng.integers(1, n + 1))
            docs, shares = rng.choice(n, m, replace=False), np.round(rng.random(m) * 2.5 + 0.01, 1 if trial % 3 == 0 else 6)
            order = np.lexsort((docs, -shares))
            docs, shares, weight = docs[order], shares[order], float(rng.exponential() + 0.01)
            ends = np.minimum(np.arange(0, m, 4) + 4, m)
            lists.append((weight, impact.Postings(docs, shares, shares[::4], ends)))
            full[docs] += weight * shares
        got, scores, _ = impact.best(lists, n, k)
        found = np.flatnonzero(full > 0)
        assert got.tolist() == found[np.lexsort((found, -np.round(full[found], 9)))[:k]].tolist() and np.allclose(scores, full[got])


def test_impact_search_equals_scoring_everything_and_scores_less(spark, tmp_path):
    rng = random.Random(6)
    docs, asked = documents(spark, rng, 400), questions(spark, rng, 12)
    index = lexical.build_index(docs)
    built = impact.build(index, shard=150, block=8)
    built.save(f"file://{tmp_path}/impact")
    want = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in lexical.top_k(lexical.score(index, asked).withColumn("s", F.round("score", 9)), 5, score_col="s").collect()}
    for i in (built, impact.ImpactIndex.load(spark, f"file://{tmp_path}/impact")):
        assert {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in impact.search(i, asked, 5, part=5).collect()} == want
    row = impact.work(built, asked, 5).first()
    assert 0 < row["scored"] <= row["postings"] * 1.2
    assert impact.search(built, asked.limit(0), 5).count() == 0


def test_contained_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None, ""]
    strings = ["".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 5))) for _ in range(80)] + [None, "zzz", "é"]
    t, s = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in strings], "string string")
    pairs = containment.contained(t, s)
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in texts for b in strings if a and b and b in a}
    assert not any(x in plan_of(pairs) for x in ("NestedLoop", "CartesianProduct"))
    assert containment.contained(t, s.limit(0)).count() == 0


@pytest.mark.parametrize("most", [containment.TERMS, 0])
def test_dictionary_of_many_terms(spark, most):
    rng = random.Random(8)
    terms = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), [f"x{i % 50}", f"y{i % 7}"]) for i in range(3000)] + [(3000, "Mitte", []), (3001, "é", ["accent"])]
    texts = [(i, "  " + "".join(rng.choice("abcd ") for _ in range(20)) + " ") for i in range(40)] + [(98, "é"), (99, None), (100, ""), (101, "Mitte")]
    got = {r["query_id"]: r["expanded"] for r in containment.expand_by_table(spark.createDataFrame(texts, "query_id long, query string"), spark.createDataFrame(terms, "ord int, term string, words array<string>"), most=most).collect()}
    for i, text in texts:
        plain = None if text is None else text.strip(" ")
        words = list(dict.fromkeys(w for _, t, ws in terms if plain and t in plain for w in ws))
        assert got[i] == (plain if not words else f"{plain} {' '.join(words)}")


def test_hub_with_most_edges(spark):
    edges = [("hub", f"n{i}") for i in range(200)] + [(f"n{i}", f"m{i}") for i in range(5)] + [("m0", "far"), ("far", "further")]
    e = spark.createDataFrame(edges, "source string, target string")
    centres = spark.createDataFrame([("n7",), ("further",), ("alone",)], "id string")
    got = {(r["centre"], r["id"]): r["depth"] for r in network.neighbourhood(centres, e, 4, most=None, part=16).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for c in ("n7", "further", "alone"):
        level, seen = {c}, {c: 0}
        for d in range(1, 5):
            level = {y for x in level for y in near.get(x, ())} - set(seen)
            seen |= dict.fromkeys(level, d)
        want |= {(c, x): d for x, d in seen.items()}
    assert got == want
    assert network.neighbourhood(centres, e, 3).agg(F.max("depth")).first()[0] == 2


def test_hybrid_takes_blocks_of_queries_together_and_counts_documents_once(spark, monkeypatch):
    """Documents are dealt once for several blocks of queries, and slices hold few tokens, whatever the number of queries."""
    rng = random.Random(9)
    docs, asked = documents(spark, rng, 150).cache(), questions(spark, rng, 30).cache()
    index = lexical.build_index(docs)
    plain = lambda df: sorted(tuple(r) for r in fusion.final_top_k(df, 4).collect())
    want = plain(hybrid.candidates(asked, docs, index, 4))
    monkeypatch.setattr(blocks, "TOGETHER", 3)
    got = hybrid.candidates(asked, docs, index, 4, block=5)
    assert plain(got) == want and len(want) > 60
    parts = {r["p"] for r in got.select(F.spark_partition_id().alias("p")).collect()}
    assert len(parts) > 1  # two blocks wide, each a task of its own, though they are few bytes

    def cell(queries):
        return lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([len(queries)], pa.int32()), pa.array([sum(b.num_rows for b in batches)], pa.int32())], names=["n", "m"])])

    held = blocks.product(asked.select("query_id"), docs.select("doc_id"), cell, "n int, m int", 5).collect()
    assert sum(r["n"] for r in held) == 30 and all(r["n"] <= 5 and r["m"] == 152 for r in held)


def test_slices_hold_few_tokens(monkeypatch):
    monkeypatch.setattr(hybrid, "TOKENS", 100)
    lengths = [0, 30, 250, 40, 60, 1, None, 99]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([None if n is None else ["w"] * n for n in lengths], pa.list_(pa.string()))], names=["doc_id", "tokens"])
    got = [x.column(0).to_pylist() for x in hybrid.parts([batch], 10)]
    assert sum(got, []) == list(range(8)) and all(len(x) == 1 or sum(lengths[i] or 0 for i in x) <= 100 for x in got)
    assert [len(x.column(0)) for x in hybrid.parts([batch], hybrid.SLICE)] == [1] * 8


def test_all_documents_alike_and_documents_without_vectors():
    """Equal scores everywhere, and fewer candidates than k: exactly those with a common term are found."""
    f64 = pa.list_(pa.float64())
    table = pa.table({"query_id": [1, 2, 3], "terms": pa.array([["a"], ["z"], ["b"]]), "weights": pa.array([[1.0], [1.0], [2.0]]), "v": pa.array([None, None, [1.0, 0.0]], f64), "b0": [1.0, 0.0, 0.0], "b1": [1.0, 0.0, 2.0], "s0": [0.0, 0.0, 0.0], "s1": [0.0, 0.0, 1.0]})
    docs = [["a"]] * 40 + [["a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(41)), pa.array(docs, pa.list_(pa.string())), pa.array([[1.0, 0.0] if i in (7, 9) else None for i in range(41)], f64)], names=["doc_id", "tokens", "v"])
    rows = pa.Table.from_batches(list(hybrid.Fused(5, 0.6, 1.0, 1.5, 0.0)(table)(iter([batch])))).to_pylist()
    found = {q: sorted(r["doc_id"] for r in rows if r["query_id"] == q) for q in (1, 2, 3)}
    assert found == {1: [0, 1, 2, 3, 4], 2: [], 3: [7, 9, 40]}


def test_words_of_requests_are_not_looked_for_in_what_they_are_joined_from(spark, monkeypatch):
    """Requests are made by a join; their words are cut once, of requests alone, and nothing is pushed below the join."""
    left = spark.range(20).withColumnRenamed("id", "query_id")
    parts = spark.range(5000).selectExpr("id as query_id", "concat('pump number ', id) as query")
    records = spark.createDataFrame([(f"d{i}", ["pump", str(i)], None) for i in range(30)], "doc_id string, tokens array<string>, embedding array<double>")
    catalog = pipelines.Catalog(None, lexical.build_index(records), records, None, None, None, None)
    plans = []
    own = hybrid.candidates
    monkeypatch.setattr(hybrid, "candidates", lambda asked, *a, **k: plans.append(asked._jdf.queryExecution().optimizedPlan().toString()) or own(asked, *a, **k))
    got = pipelines.candidates(left.join(parts, "query_id").withColumnRenamed("query", "keyword_query"), catalog, 3)
    assert "Join" not in plans[0] and got.select("query_id").distinct().count() == 20
