"""What must not grow faster than its input: the same results as the plain forms, without their rows."""

import duckdb
import numpy as np
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F

from procmatch import catalog_queries, queries
from procmatch.functions import extract, text
from procmatch.operators import blocks, containment, evaluate, fusion, hybrid, impact, lexical, network, report, versions
from procmatch.plans import pipelines


def _graph(spark):
    nodes = spark.createDataFrame([(f"P-{i}", f"IS {i}", f"t{i}", f" c{i % 3} " if i % 7 else None, i) for i in range(40)], "id string, is_number string, title string, product_category string, ord long")
    declared = network._labelled(spark.createDataFrame([("P-1", "P-4"), ("P-4", "P-1"), ("P-8", "P-2"), ("P-3", "P-5"), ("P-0", "P-9")], "source string, target string"), "RELATED_STANDARD")
    return nodes, declared, declared.unionByName(network.inferred_edges(nodes, declared))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_graph_without_rows_for_pairs(spark):
    nodes, declared, edges = _graph(spark)
    place = {r.id: (r.ord, (r.product_category or "").strip()) for r in nodes.collect()}
    known = {frozenset((r.source, r.target)) for r in declared.collect()}
    want = {(a, b) for a, (i, c) in place.items() for b, (j, d) in place.items() if c and c == d and i < j and frozenset((a, b)) not in known}
    assert {(r.source, r.target) for r in edges.where("is_inferred").collect()} == want
    missing = spark.createDataFrame([("P-1", "x")], "source string, ref string")
    assert _rows(network.stats_of(nodes, declared, missing)) == _rows(network.stats(nodes, edges, missing)) == [(40, 5 + len(want), 5, len(want), 1)]
    keep = ["id", "neighbour", "relationship_type", "relationship_label", "is_inferred", "way"]
    assert _rows(network.neighbours_of(nodes, declared).select(keep)) == _rows(network.neighbours(edges).select(keep))
    plan = network.neighbours_of(nodes, declared)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Window" not in plan
    assert _rows(network.incident_of(nodes, declared)) == _rows(network.incident(edges, nodes))


def test_neighbourhood_without_edges_of_categories(spark):
    nodes, declared, edges = _graph(spark)
    centres = nodes.where("ord % 3 = 1 or ord = 0").select("id")
    for depth in (1, 3):
        got = _rows(network.neighbourhood_of(centres, nodes, declared, depth, most=None))
        plain = {c.id: {c.id: 0} for c in centres.collect()}
        near = {(u, v) for r in edges.collect() for u, v in ((r.source, r.target), (r.target, r.source))}
        for reached in plain.values():
            for d in range(1, depth + 1):
                reached.update({v: d for u, v in near if u in reached and v not in reached})
        assert got == sorted(((c, i, d) for c, reached in plain.items() for i, d in reached.items()), key=str) == _rows(network.neighbourhood(centres, edges, depth, most=None))
    # Nodes that share their place have no edge of their own: one step more, by the third.
    same = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "x", 2), ("d", None, 3), ("e", "y", 4)], "id string, product_category string, ord long")
    none = spark.createDataFrame([], "source string, target string")
    assert _rows(network.neighbourhood_of(same.where("id in ('a', 'd', 'e')"), same, none, 2)) == [("a", "a", 0), ("a", "b", 2), ("a", "c", 1), ("d", "d", 0), ("e", "e", 0)]


def test_more_centres_than_a_block_holds(spark):
    nodes = spark.range(2500).selectExpr("concat('P-', id) as id", "concat('c', id div 5) as product_category", "id as ord")
    declared = spark.range(2499).selectExpr("concat('P-', id) as source", "concat('P-', id + 1) as target")
    got = network.neighbourhood_of(nodes, nodes, declared, 1)
    # In its category each node meets four others, and at its category's borders one of the next.
    assert got.count() == got.distinct().count() == 2500 * 5 + 2 * 499
    assert got.groupBy("centre").agg(F.count("*").alias("n")).where("n not between 5 and 6").count() == 0


def test_neighbours_of_wanted_documents_only(spark):
    nodes, declared, edges = _graph(spark)
    c = pipelines.Catalog(None, None, None, None, nodes, edges, None, declared)
    rows = spark.createDataFrame([("P-1", 1), ("P-7", 2), ("P-9", 3), ("P-1", 4), ("P-0", 5)], "doc_id string, n int")
    told = {r.doc_id: r.neighbours for r in c.near().collect()}
    for catalog in (c, pipelines.Catalog(None, None, None, None, nodes, edges, None)):
        got = catalog.with_neighbours(rows, rows.select("doc_id").distinct()).collect()
        assert sorted(r.n for r in got) == [1, 2, 3, 4, 5]
        assert all(r.neighbours == told.get(r.doc_id, []) for r in got)
    assert c.without_inferred().with_neighbours(rows, rows.select("doc_id").distinct()).where(F.exists("neighbours", lambda x: x["is_inferred"])).count() == 0


def test_longer_grams_keep_numbers_apart(spark):
    """With runs of three characters each number met every text that shares three digits."""
    keys = spark.range(1000, 3000).select(F.concat(F.lit("is "), "id").alias("string"))
    texts = spark.range(1000, 3000).select(F.concat(F.lit("is "), "id", F.lit(" (part 1)")).alias("text"))
    got = containment.contained(texts, keys)
    assert {(r.text, r.string) for r in got.collect()} == {(f"is {i} (part 1)", f"is {i}") for i in range(1000, 3000)}
    looked_at = containment.looked_at(texts, keys)
    assert looked_at.count() == 2000
    short = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",), ("bcdefg",), ("abcdefghijkl",)], "string string")
    long = spark.createDataFrame([("abcdefghijklm",), ("xab",), (None,)], "text string")
    assert {(r.text, r.string) for r in containment.contained(long, short).collect()} == {("abcdefghijklm", s) for s in ("a", "ab", "abc", "bcdefg", "abcdefghijkl")} | {("xab", "a"), ("xab", "ab")}


def test_encode_queries_at_single_precision(spark):
    """Item 140 has 0.178964996, which as a float is 0.178965002, so it rounds otherwise than in double precision."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    want = dict(con.execute(queries.ORACLES["encode_queries"]).fetchall())
    got = {r["item_id"]: list(r["head"]) for r in queries.encode_queries(spark, sf).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)


def test_hybrid_products_against_plain_sums():
    """Terms of many queries go through a matrix, others are added one by one; both, and equal documents, give the plain sums."""
    rng = np.random.default_rng(3)
    f64, n = pa.list_(pa.float64()), 1200
    docs = [[f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 12)) % 900] for _ in range(150)]
    docs = docs + docs[:40] + [None]
    asked = [{f"w{x}": float(rng.random() + 0.1) for x in rng.zipf(1.4, 6) % 900} for _ in range(n)]
    table = pa.table({"query_id": pa.array(range(n)), "terms": pa.array([list(q) for q in asked]), "weights": pa.array([list(q.values()) for q in asked]), "v": pa.array([None] * n, f64)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.string())), pa.array([None] * len(docs), f64)], names=["doc_id", "tokens", "v"])
    block = hybrid.Asked(table, 6.0, 1.5, 0.75)
    assert 0 < len(block.columns) < len(block.words)
    got = block.lexical(batch)
    share = lambda d, t: d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / 6.0))
    want = np.array([[sum(w * share(d, t) for t, w in q.items() if d and t in d) for d in docs] for q in asked])
    assert np.allclose(got, want, rtol=0, atol=1e-9) and ((got == 0) == (want == 0)).all()
    assert (got[:, :40] == got[:, 150:190]).all()
    b0, b1 = got.min(1), got.max(1)
    limits = table.append_column("b0", pa.array(b0)).append_column("b1", pa.array(b1)).append_column("s0", pa.array(np.zeros(n))).append_column("s1", pa.array(np.zeros(n)))
    rows = pa.Table.from_batches(list(hybrid.Fused(5, 0.6, 6.0, 1.5, 0.75)(limits)(iter([batch])))).to_pylist()
    score = np.where(got > 0, hybrid.half_up(0.4 * hybrid.scaled(got, b0[:, None], b1[:, None])), -1)
    best = {q: [d for d in np.lexsort((np.arange(len(docs)), -score[q]))[:5] if score[q, d] >= 0] for q in range(n)}
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], -r["relevance_score"], r["doc_id"])):
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    assert all(found.get(q, [])[:5] == best[q] for q in range(n))
    assert blocks.BLOCK >= n


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_of_amendments_reads_each_history_once(spark):
    items = ['{"amendment_number": "2", "year": "2019", "title": "Change 6"}', '{"amendment_number": 1, "year": "2021"}', "bare"]
    rows = spark.createDataFrame([("a", "IS 1", "Active", 2001, items), ("b", "IS 2", "Superseded", None, []), ("c", "IS 3", None, 1999, None)], "id string, is_number string, status string, revision_year int, amendments array<string>")
    got = versions.search(versions.add_versions(rows), "change 6")
    assert [(r.id, r.latest_number, r.latest_year) for r in got.collect()] == [("a", 1, 2021)]
    assert [[tuple(x) for x in r.amendment_history] for r in got.collect()] == [[(1, 2021, "Amendment No. 1"), (2, 2019, "Change 6")]]
    assert _plan(got).count("from_json") + _plan(got).count("JsonToStructs") <= 1


def test_requirements_and_keywords_need_no_shuffle(spark):
    texts = [(i, " ".join(["the", "42", "Pump", "पंप", "٤٢٣", "pump-set", "cable"] * (i + 1) + ["x1"] * i + ["zebra"])) for i in range(30)] + [(98, ""), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = text.keywords_of(docs)
    want = {}
    for i, t in texts:
        words = [w for w in (t or "").lower().split() if len(w) > 2 and w != "the" and not w.isdecimal()]
        if words:
            want[i] = sorted(dict.fromkeys(words), key=lambda w: -words.count(w))[:10]
    found = {r.doc_id: r.keywords for r in got.collect()}
    assert set(found) == set(want)
    assert all([w for w in found[i] if w.isascii()] == [w for w in want[i] if w.isascii()] for i in want)
    full = extract.extract_requirements(docs)
    assert {r.doc_id: r.requirements.keywords for r in full.collect()} == {i: found.get(i, []) for i, _ in texts}
    assert "Exchange" not in _plan(got) and "Exchange" not in _plan(full)


def test_few_queries_are_scored_where_documents_lie(spark):
    words = ["pump", "cable", "slag", "lamp", "pipe"]
    docs = spark.createDataFrame([(i, [words[j % 5] for j in range(i, i + i % 7)] or None) for i in range(200)] + [(500, [None, "pump"])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["pump", "pump", "slag"]), (2, ["cable"]), (3, ["nothing"]), (4, [])], "query_id long, tokens array<string>")
    for idf in ("plus_one", "okapi"):
        index = lexical.build_index(docs, idf=idf)
        plain = lexical.LexicalIndex(index.postings, index.stats, index.terms)
        pairs = lambda df: {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}
        got = lexical.score(index, asked)
        assert pairs(got) == pairs(lexical.score(plain, asked)) == pairs(lexical.score(plain, asked, most=0)) != {}
        assert "Exchange" not in _plan(got)
        every = pairs(lexical.score(index, asked, every=True))
        assert every == {(q, d.doc_id): pairs_of.get((q, d.doc_id), 0.0) for pairs_of in [pairs(got)] for q in (1, 2, 3, 4) for d in docs.collect()}
    counts = {(r.doc_id, r.term): (r.tf, r.dl) for r in index.postings.collect()}
    assert counts == {(d.doc_id, t): (d.tokens.count(t), len(d.tokens)) for d in docs.collect() for t in d.tokens or [] if t} and "Exchange" not in _plan(index.postings)
    assert "Exchange" not in _plan(fusion.min_max(lexical.score(index, asked))).replace("BroadcastExchange", "")


def test_links_each_once_without_comparing_all(spark):
    item = lambda i, way=0: (way, f"P-{i}", None if i % 2 else "x")
    hits = [(1, 2, [item(3), item(1), item(4, 1)]), (1, 1, [item(5), item(3)]), (1, 3, [item(1), item(1, 1), item(5)]), (2, 1, []), (3, 1, [item(7)])]
    ranked = spark.createDataFrame(hits, "query_id long, rank int, neighbours array<struct<way: int, standard_id: string, title: string>>")
    got = report.network_links(ranked)
    assert {r.query_id: [tuple(x) for x in r.network_information] for r in got.collect()} == {1: [item(5), item(3), item(1), item(4, 1), item(1, 1)], 2: [], 3: [item(7)]}
    assert "array_distinct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_best_by_words_for_many_queries(spark):
    words = ["pump", "cable", "slag", "lamp", "pipe"]
    docs = spark.createDataFrame([(i, [words[j % 5] for j in range(i, i + i % 7)] or None, None) for i in range(200)], "doc_id long, tokens array<string>, embedding array<double>")
    asked = spark.createDataFrame([(q, [words[q % 5], words[(q * 3 + 1) % 5], "none"] if q % 4 else []) for q in range(60)], "query_id long, tokens array<string>")
    index = lexical.build_index(docs)
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())
    want = rows(impact.search(impact.build(index), asked, 7))
    assert want and rows(hybrid.by_words(asked, docs, index, 7)) == want == rows(hybrid.by_words(asked, docs, index, 7, block=8))


def test_systems_are_fused_once_and_need_no_links(spark, monkeypatch):
    nodes, _, _ = _graph(spark)
    empty = F.array().cast("array<string>")
    records = nodes.withColumns({"scope": F.concat(F.lit("covers "), "title"), "sector": F.lit("s"), "keywords": empty, "related_standards": empty, "description": F.lit(None).cast("string")})
    v = nodes.select(F.col("id").alias("doc_id"), F.array(F.col("ord") * 1.0, F.lit(1.0)).alias("embedding"))
    catalog = pipelines.Catalog.build(records, None, v, linked=False)
    assert catalog.edges is None
    asked = spark.createDataFrame([(i, f"covers t{i} t{i + 1}", [float(i), 1.0]) for i in (3, 8, 20)], "query_id long, query string, embedding array<double>")
    fused, calls = pipelines.candidates, []
    monkeypatch.setattr(pipelines, "candidates", lambda *a, **k: calls.append(1) or fused(*a, **k))
    got = pipelines.systems(asked, catalog, fusion.overlap_scorer, 4)
    assert {(r.system, r.query_id): r["count"] for r in got.groupBy("system", "query_id").count().collect()} == {(s, q): 4 for s in ("bm25", "dense", "hybrid", "reranked") for q in (3, 8, 20)}
    assert len(calls) == 1


def test_ideal_gains_without_sorting_judgements(spark):
    good = [(q, d, 1 + d % 3 % 2) for q in range(3) for d in range(q, 9)]
    rels = spark.createDataFrame(good, "query_id int, doc_id int, rel int")
    ranked = spark.createDataFrame([("a", q, (d * 4 + q) % 9, d + 1) for q in range(3) for d in range(9)], "system string, query_id int, doc_id int, rank int")
    got = evaluate.per_query(ranked, rels, rels.select("query_id").distinct())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rel#" in plan and "doc_id" not in plan[plan.index("Window") :].split("\n")[0]
    grade = {(q, d): r for q, d, r in good}
    for row in got.collect():
        hits = [grade.get((row.query_id, (d * 4 + row.query_id) % 9), 0) for d in range(9)]
        best = sorted((r for (q, _), r in grade.items() if q == row.query_id), reverse=True)
        dcg = lambda rs: sum((2**r - 1) / np.log2(i + 2) for i, r in enumerate(rs))
        assert np.isclose(row.ndcg_at_3, dcg(hits[:3]) / dcg(best[:3])) and np.isclose(row.ndcg_at_5, dcg(hits[:5]) / dcg(best[:5]))
        assert np.isclose(row.r_at_5, sum(r > 0 for r in hits[:5]) / len(best))


def test_growing_tables_are_not_broadcast(spark):
    """Small as they are here, neither keys of records nor neighbours' lists go through the driver."""
    nodes, declared, edges = _graph(spark)
    refs = spark.createDataFrame([("P-1", "IS 4"), ("P-2", "Standard IS 13 x")], "source string, ref string")
    catalog = pipelines.Catalog(None, None, None, None, nodes, edges, None, declared)
    hits = spark.createDataFrame([("P-1", 1), ("P-8", 2)], "doc_id string, rank int")
    for df in (network.resolve(refs, nodes), network._with_excluded(nodes, declared, "product_category"), catalog.with_neighbours(hits, hits.select("doc_id"))):
        assert all("[_g#" in line for line in _plan(df).splitlines() if "BroadcastHashJoin" in line)  # grams of strings wanted are sized as they are


def test_few_cells_are_worked_out_for_larger_k():
    near = np.random.default_rng(5).random((50, 240)).astype(np.float32)
    none = np.full(50, -np.inf)
    q, d = blocks.promising(near, 24, none, 0.0, none)
    found = set(zip(q.tolist(), d.tolist(), strict=True))
    assert len(q) < near.size / 3 and all((r, c) in found for r in range(50) for c in np.argsort(-near[r])[:24])
    best = blocks.Best(2, 3, ["doc_id"])
    for x in range(40):
        best.add(np.array([0, 1]), np.array([x % 7 / 7, x % 5 / 5]), {"doc_id": pa.array([x, x])})
    assert best.rows.select(["_q", "doc_id"]).to_pylist() == [{"_q": q, "doc_id": d} for q, ds in ((0, (6, 13, 20)), (1, (4, 9, 14))) for d in ds]


def test_induced_edges_without_edges_of_categories(spark):
    nodes, declared, edges = _graph(spark)
    centres = nodes.where("ord % 3 = 1 or ord in (0, 7, 8, 9)").select("id")
    want = network.induced_edges(network.neighbourhood(centres, edges, 1), edges)
    columns = ["centre", *edges.columns]
    assert _rows(network.induced_of(centres, nodes, declared).select(columns)) == _rows(want.select(columns)) != []
    # Some of a category share their place: these have no edge of their own, and declared edges reach into other categories.
    rows = [("a", 1, "x"), ("b", 1, "x"), ("c", 2, "x"), ("d", 3, None), ("e", 4, "y"), ("f", 5, "y"), ("g", 6, "y"), ("h", None, "y")]
    same = spark.createDataFrame([(i, o, c) for i, o, c in rows], "id string, ord long, product_category string")
    said = network._labelled(spark.createDataFrame([("a", "e"), ("a", "f"), ("b", "d"), ("d", "a"), ("g", "e"), ("h", "b"), ("e", "c"), ("c", "d")], "source string, target string"), "RELATED_STANDARD")
    every = said.unionByName(network.inferred_edges(same, said))
    want = network.induced_edges(network.neighbourhood(same.select("id"), every, 1), every)
    assert _rows(network.induced_of(same.select("id"), same, said).select(columns)) == _rows(want.select(columns))


def test_references_are_worked_out_once(spark):
    plan = queries.resolved(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "lineitem" not in plan
