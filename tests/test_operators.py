import json

import pytest
from pyspark.sql import functions as F

from procmatch.operators import certify, dense, evaluate, fusion, gaps, lexical, network, sync, versions
from procmatch.sources import corpus, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_min_max(spark):
    s = spark.createDataFrame([("q", i, float(v)) for i, v in enumerate([10, 20, 30, 40, 50])] + [("flat", 1, 2.0), ("flat", 2, 2.0), ("zero", 1, 0.0)], "query_id string, doc_id int, score double")
    got = {(q, d): n for q, d, _, n in rows(fusion.min_max(s).select("query_id", "doc_id", "score", "norm"))}
    assert [got["q", i] for i in range(5)] == [0, 0.25, 0.5, 0.75, 1] and got["flat", 1] == 1.0 and got["zero", 1] == 0.0
    n = spark.createDataFrame([(6,)], "n int")
    sparse = {(q, d): x for q, d, _, x in rows(fusion.min_max_sparse(s, n).select("query_id", "doc_id", "score", "norm"))}
    assert sparse["q", 0] == 0.2 and sparse["flat", 1] == 1.0 and sparse["zero", 1] == 0.0


def test_lexical_scores_by_broadcast_and_by_term(spark):
    docs = [(f"d{i}", ["is", "mm", *(["pipe"] * (i % 3)), f"w{i % 7}"]) for i in range(50)] + [("empty", []), ("none", None)]
    asked = [("q1", ["is", "pipe", "pipe", "w3"]), ("q2", ["mm", "unknown"]), ("q3", []), ("q4", ["unknown"])]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id string, tokens array<string>"))
    queries = spark.createDataFrame(asked, "query_id string, tokens array<string>")
    one, other = ({(q, d): s for q, d, s in rows(lexical.score(index, queries, **how))} for how in ({}, {"most": 0, "part": 8}))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)
    stats, idf = index.stats.first(), {r["term"]: r["idf"] for r in index.terms.collect()}
    for q, ts in asked:
        for d, ws in docs:
            ws = ws or []
            want = [idf[t] * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / stats["avgdl"])) for t in ts if t in ws]
            assert ((q, d) in one) == bool(want) and abs(one.get((q, d), 0.0) - sum(want)) < 1e-12


def test_rerank(spark):
    c = fusion.with_pool(spark.createDataFrame([("q", i, s) for i, s in enumerate([0.8, 0.6, 0.4])], "query_id string, doc_id int, relevance_score double"), 2)
    raw = spark.createDataFrame([("q", 0, -1.0), ("q", 1, 2.0)], "query_id string, doc_id int, cross_encoder_raw double")
    got = {r["doc_id"]: r for r in fusion.rerank(c, raw, 0.5).collect()}
    assert got[0]["relevance_score"] == round(0.5 * 0.26894142 + 0.4, 4) and got[1]["relevance_score"] == round(0.5 * 0.88079708 + 0.3, 4) and got[2]["relevance_score"] == 0.4
    assert [got[i]["reranked"] for i in range(3)] == [True, True, False]
    plain = fusion.rerank(c, None).collect()
    assert not any(r["reranked"] for r in plain) and {r["relevance_score"] for r in plain} == {0.8, 0.6, 0.4}
    top = fusion.final_top_k(fusion.rerank(c, raw, 0.5), 50).orderBy("rank").collect()
    assert [r["doc_id"] for r in top] == [1, 0, 2] and top[0]["relative_match_score"] == 100.0
    zero = fusion.final_top_k(c.withColumn("relevance_score", F.lit(0.0)), 0).collect()
    assert len(zero) == 1 and zero[0]["relative_match_score"] == 0.0


def test_pair_scorer(spark):
    p = spark.createDataFrame([("a b", "b a c"), ("a b", "c"), (None, "x")], "query string, candidate_text string")
    assert [r["cross_encoder_raw"] for r in fusion.pair_scores(p).collect()] == [4.0, -4.0, -4.0]


def test_metrics(spark, tmp_path):
    ranked = spark.createDataFrame([("s", "q", d, i + 1) for i, d in enumerate(["IS-1180-P1", "IS-2026-P1", "IS-9"])] + [("r", "q", d, i + 1) for i, d in enumerate(["IS-2026-P1", "IS-1180-P1"])] + [("late", "q", d, i + 1) for i, d in enumerate(["x", "IS-1180-P1"])], "system string, query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", {"IS-1180-P1": 2, "IS-2026-P1": 1}), ("none", {})], "id string, relevance map<string,int>")
    queries = spark.createDataFrame([("q", "en"), ("none", "hi")], "query_id string, language string")
    m = evaluate.per_query(ranked, evaluate.judgements(gold), queries)
    got = {(r["system"], r["query_id"]): r for r in m.collect()}
    s = got["s", "q"]
    assert round(s["p_at_3"], 4) == 0.6667 and s["r_at_1"] == 0.5 and s["ndcg_at_3"] == 1.0 and s["mrr"] == 1.0
    assert round(got["r", "q"]["ndcg_at_3"], 4) == 0.7967 and got["late", "q"]["mrr"] == 0.5 and got["s", "none"]["ndcg_at_5"] == 0.0
    sinks.write_evaluation(evaluate.by_system(m), evaluate.by_group(m), m, f"file://{tmp_path}/eval")
    assert spark.read.json(f"file://{tmp_path}/eval/queries").count() == 6
    by = {(r["system"], r["language"]): r for r in evaluate.by_group(m).collect()}
    assert by["s", "ALL"]["mrr"] == 0.5 and by["s", "en"]["mrr"] == 1.0
    d = {r["metric"]: r["change"] for r in evaluate.delta(evaluate.by_system(m), "late", "s").collect()}
    assert d["mrr"] == 0.25


SAMPLE = [("IS-101", "IS 101 : 2020", ["IS 102 : 2019", "IS-101"]), ("IS-102", "IS 102 : 2019", ["IS-101", "NONEXISTENT-999"]), ("IS-103", "IS 103 : 2018", None)]


def graph(spark, category=None):
    n = spark.createDataFrame([(i, d, f"t{k}", category, k, r) for k, (i, d, r) in enumerate(SAMPLE)], "id string, is_number string, title string, product_category string, ord long, related_standards array<string>")
    r = network.resolve(network.references(n), n)
    declared = network.declared_edges(r)
    return n, r, declared, declared.unionByName(network.inferred_edges(n, declared))


def test_graph(spark):
    n, r, declared, edges = graph(spark)
    assert sorted(rows(declared.select("source", "target"))) == [("IS-101", "IS-102"), ("IS-102", "IS-101")]
    assert rows(network.unresolved(r)) == [("IS-102", "NONEXISTENT-999")]
    assert network.stats(n, edges, network.unresolved(r)).first().asDict() == {"total_nodes": 3, "total_edges": 2, "declared_edge_count": 2, "inferred_edge_count": 0, "unresolved_reference_count": 1}
    centres = spark.createDataFrame([("IS-101",), ("IS-103",)], "id string")
    assert sorted(rows(network.neighbourhood(centres, edges, 9))) == [("IS-101", "IS-101", 0), ("IS-101", "IS-102", 1), ("IS-103", "IS-103", 0)]
    _, _, _, more = graph(spark, " Pumps ")
    assert sorted(rows(more.where("is_inferred").select("source", "target"))) == [("IS-101", "IS-103"), ("IS-102", "IS-103")]
    near = {(a, b): w for a, b, w in rows(network.neighbours(more).select("id", "neighbour", "way"))}
    assert near["IS-101", "IS-102"] == 0 and near["IS-103", "IS-101"] == 1
    assert network.induced_edges(network.neighbourhood(centres, more, 1), more).where("centre = 'IS-101'").count() == 4


def test_versions(spark):
    items = [json.dumps({"amendment_number": a, "year": y, "title": "t"}) for a, y in ((2, 2014), (1, 2009), (3, 2021))]
    bad = ['"bare"', '{"amendment_number": "invalid_num", "year": "2018"}', '{"amendment_number": 2, "year": null, "title": null}']
    df = spark.createDataFrame([("a", "IS 1", "Active", "2012.7", items), ("b", "IS 2", "Withdrawn", None, None), ("c", None, None, "x", bad)], "id string, is_number string, status string, revision_year string, amendments array<string>")
    got = {r["id"]: r for r in versions.add_versions(df).collect()}
    assert [a["year"] for a in got["a"]["amendment_history"]] == [2021, 2014, 2009] and got["a"]["revision_year"] == 2012 and got["a"]["latest_number"] == 3
    assert got["b"]["version_status"] == "Superseded" and got["c"]["amendment_count"] == 2
    assert [(a["amendment_number"], a["year"], a["title"]) for a in got["c"]["amendment_history"]] == [(None, 2018, "Amendment No. Unnumbered"), (2, None, "Amendment No. 2")]
    assert versions.search(versions.add_versions(df), "2021").count() == 1


def test_certification(spark, tmp_path):
    rules = [
        {"rule_id": "R1", "standard_ids": [" IS-1 "], "product_category": "Pumps", "certification_scheme": "Mark", "indication": None},
        {"rule_id": "R2", "standard_ids": ["is-1"], "certification_scheme": "Later", "indication": "historical", "superseded_by": "2025 order"},
        {"no_id": 1},
    ]
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    r = corpus.read_rules(spark, f"file://{tmp_path}/rules.json")
    recs = spark.createDataFrame([("IS-1", "x", "Pumps"), ("IS-2", "x", " pumps "), (None, "x", "none")], "id string, is_number string, product_category string")
    got = {r["matched_standard_id"]: r for r in certify.assess(recs, r).collect()}
    assert got["IS-1"]["rule_id"] == "R2" and got["IS-1"]["superseded_by"] == "2025 order" and got["IS-2"]["rule_id"] == "R1" and got["IS-2"]["indication"] == fusion.CANDIDATE and got["x"]["match_kind"] == "unmapped"
    req = spark.createDataFrame([("a", ["IS-1", "IS-1", ""], "Pumps"), ("b", [], None)], "request_id string, standard_ids array<string>, product_category string")
    assert sorted(rows(certify.summarize_requests(req, certify.assess_requests(req, r)))) == [("a", 2, True), ("b", 0, False)]
    assert certify.search_rules(r, "mark").count() == 1
    (tmp_path / "broken.json").write_text("{not json")
    assert corpus.read_rules(spark, f"file://{tmp_path}/broken.json").count() == 0


def test_gap_levels(spark):
    req = spark.createDataFrame([("q", "REQ-001", "t", "product_type", "hdpe potable water supply pipe"), ("q", "REQ-002", "t", "acoustic", "45 db"), ("q", "REQ-003", "t", "safety", "noise wall"), ("none", "REQ-001", "t", "keyword", "x")], "query_id string, requirement_id string, requirement_text string, category string, value string")
    cand = spark.createDataFrame([("q", 1, "d", "IS 4984", "Polyethylene pipes", "Covers PE pipes for potable water supply", None, ["hdpe", "water"], "Pipes", ["r"])], "query_id string, rank int, doc_id string, is_number string, title string, scope string, description string, keywords array<string>, product_category string, reasons array<string>")
    got = {(r["query_id"], r["requirement_id"]): r for r in gaps.coverage(req, gaps.match(req, cand)).collect()}
    assert got["q", "REQ-001"]["status"] == "covered" and got["q", "REQ-001"]["supporting_standard_ids"] == ["IS 4984"]
    assert got["q", "REQ-002"]["status"] == "not_evidenced" and got["q", "REQ-002"]["coverage_score"] == 0.0 and got["q", "REQ-002"]["supporting_standard_ids"] == []
    assert got["q", "REQ-003"]["status"] == "requires_verification" and got["none", "REQ-001"]["status"] == "not_evidenced"


def table(spark, values):
    return spark.createDataFrame(values, "id string, title string, keywords array<string>")


def test_sync(spark):
    left = table(spark, [("IS-101", "a", ["x"]), ("IS-102", "b", None)])
    right = table(spark, [("IS-101", " a ", ["x "]), ("IS-102", "changed", None), ("IS-103", "c", [])])
    assert sorted(rows(sync.id_diff(left, right))) == [("IS-101", "common"), ("IS-102", "common"), ("IS-103", "extra")]
    assert rows(sync.field_diff(left, right, ["id", "title", "keywords"])) == [("IS-102", "title", "b", "changed")]
    assert sync.comparison(left, right, ["title", "keywords"]).first()["status"] == "OUT_OF_SYNC"
    assert sync.comparison(left, right.limit(0), ["title"]).first()["status"] == "EMPTY_POSTGRES" and sync.comparison(left, left, ["title"]).first()["status"] == "IN_SYNC"
    kept = sync.synchronized(sync.actions(left, right, ["title", "keywords"]))
    assert sorted(r["id"] for r in kept.collect()) == ["IS-101", "IS-102", "IS-103"] and {r["id"]: r["title"] for r in kept.collect()}["IS-102"] == "b"
    assert sync.synchronized(sync.actions(left, right, ["title"], delete_extra=True)).count() == 2
    assert sync.action_counts(sync.actions(kept, kept, ["title"])).first()["unchanged"] == 3


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = table(spark, [("1", "a", []), ("2", "b", [])])
    assert sinks.seed(a, path) == {"inserted": 2, "updated": 0, "deleted": 0, "total": 2}
    assert sinks.seed(table(spark, [("2", "c", []), ("3", "d", [])]), path) == {"inserted": 1, "updated": 1, "deleted": 0, "total": 3}
    assert {r["id"]: r["title"] for r in sinks.read_table(spark, path).collect()} == {"1": "a", "2": "c", "3": "d"}
    assert sinks.seed(a, path, clear_existing=True)["deleted"] == 3
    assert sinks.clear(spark, path) == 2 and sinks.read_table(spark, path).count() == 0
    sinks.write_json(a, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2


def test_vector_upsert(spark):
    recs = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", ""), ("4", "z")], "id string, c string")
    enc = spark.createDataFrame([("1", [1.0]), ("2", [1.0, 2.0]), ("4", [3.0])], "id string, embedding array<double>")
    old = spark.createDataFrame([("1", "x", [0.5], "m", 1, None, None), ("4", "older", [0.5], "m", 1, None, None), ("4", "older", [0.5], "n", 1, None, None)], "standard_id string, content string, embedding array<float>, embedding_model string, embedding_dimension int, created_at timestamp, updated_at timestamp")
    c = sinks.classify_vectors(recs, enc, old, 1, "m", F.col("c"))
    assert {r["id"]: r["outcome"] for r in c.collect()} == {"1": "updated", "2": "failed", "3": "skipped", "4": "inserted"}
    assert sinks.vector_counts(c).first().asDict() == {"processed": 4, "valid": 3, "inserted": 1, "updated": 1, "skipped": 1, "failed": 1}
    new = sinks.upsert_vectors(c, old, "m")
    assert sorted((r["standard_id"], r["content"], r["embedding_model"]) for r in new.collect()) == [("1", "x", "m"), ("4", "older", "n"), ("4", "z", "m")]


def test_read_corpus(spark, tmp_path):
    data = [{"is_number": "IS 1 : 2/3", "title": "a", "status": "Active"}, {"id": "k", "is_number": "IS 2", "title": "b", "revision_year": 2012, "amendments": [{"year": 1}, "bare"]}]
    (tmp_path / "s.json").write_text(json.dumps(data))
    got = corpus.read_corpus(spark, f"file://{tmp_path}/s.json").orderBy("ord").collect()
    assert got[0]["id"] == "IS-1---2-3" and got[0]["status"].endswith("(DEMO / SAMPLE DATA)") and got[0]["keywords"] == []
    assert got[1]["id"] == "k" and got[1]["amendments"] == ['{"year":1}', "bare"] or got[1]["amendments"] == ['{"year": 1}', "bare"]
    with pytest.raises(Exception, match=r"(?i)path"):
        corpus.read_corpus(spark, f"file://{tmp_path}/none.json").count()
    f = spark.createDataFrame([("a.PDF", b"%PDF-1"), ("a.txt", b"%PDF-"), ("b.pdf", b""), ("c.pdf", b"x"), ("d.pdf", None)], "path string, content binary")
    assert [r[0] for r in f.select(corpus.reject_reason("path", "content")).collect()] == [None, "unsupported_extension", "empty_file", "not_a_pdf", "empty_file"]


def test_dense(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [-1.0, 0.0])], "doc_id int, embedding array<float>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], "query_id string, embedding array<float>")
    for block in (1, 10):
        got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 4)) for r in dense.search(q, docs, 2, block=block).collect()}
        assert got == {("a", 1): (1, 1.0), ("a", 2): (3, 0.7071), ("c", 1): (3, 0.7071), ("c", 2): (1, 0.0)}
    assert {r["reject_reason"] for r in dense.check_dimension(docs, 3).collect()} == {"dimension_mismatch", "missing"}
    with pytest.raises(Exception, match="wrong vector dimension"):
        dense.check_dimension(docs.where("doc_id = 1"), 3, strict=True).collect()
