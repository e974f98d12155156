"""Registered queries over a catalog with everything: vectors, amendments, references, neighbours, certification; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch import queries as core
from procmatch.operators import evaluate, evidence, fusion
from procmatch.plans import pipelines
from procmatch.queries import CATALOG_SQL, CERT_CTE, GRAPH_CTES, GRAPH_NODE_SQL, ORACLES, REFERENCE_SQL, REQUEST_SQL, cos_sql, joined, norm_sql, query, spread, table, tokens_sql, with_vector
from procmatch.sources import shared, sinks
from procmatch.streaming import enrich

FULL_SQL = CATALOG_SQL.replace("p_brand AS product_category", "concat(p_brand, '/', p_size) AS product_category").replace(
    "p_partkey AS ord",
    """p_partkey AS ord, p_size AS size, CAST(p_partkey % 3 AS INT) AS n_amendments,
  CASE WHEN p_partkey % 4 = 1 THEN concat('P-', p_partkey + 1) WHEN p_partkey % 4 = 2 THEN concat('IS ', 1002 + p_partkey, ' (Part 1) : 2001') WHEN p_partkey % 40 = 3 THEN 'ISO X' END AS ref""",
)
FULL_DUCK = FULL_SQL.replace("{list}", "list_value")


def full_records(spark, sf) -> DataFrame:
    """Parts as records: up to two amendments, a reference each for most of them, categories small enough for inferred neighbours."""
    rows = spark.sql(FULL_SQL.replace("{list}", "array").replace("FROM part", "FROM {part}"), part=spread(table(spark, sf, "part")))
    one = lambda i: F.concat(F.lit('{"amendment_number": '), i.cast("string"), F.lit(', "year": "'), (2000 + (F.col("size") + 3 * i) % 20).cast("string"), F.lit('", "title": "Change '), i.cast("string"), F.lit('"}'))
    none = F.array().cast("array<string>")
    listed = F.when(F.col("n_amendments") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_amendments", F.lit(1))), one)).otherwise(none)
    return rows.withColumns({"amendments": listed, "related_standards": F.when(F.col("ref").isNull(), none).otherwise(F.array("ref")), "source_url": F.lit(None).cast("string")}).drop("size", "n_amendments", "ref")


def full_catalog(spark, sf, with_vectors: bool = True, linked: bool = True) -> pipelines.Catalog:
    """Part n has the vector n modulo their number."""
    rows = full_records(spark, sf)
    v = with_vector(spark, sf, rows.select(F.col("id").alias("doc_id"), "ord"), "ord", 1).select("doc_id", "embedding") if with_vectors else None
    return pipelines.Catalog.build(rows, core.rules(spark, sf), v, linked)


def full_requests(spark, sf) -> DataFrame:
    return with_vector(spark, sf, core.requests(spark, sf), "query_id", 7)


def pair_scorer():
    """The default scorer, a little lower, so that no score is exactly 0 and no fused score lies between two roundings."""
    own = fusion.overlap_scorer()
    return lambda queries, texts: [x - 0.05 for x in own(queries, texts)]


def ranked_sql(asked: str, semantic: bool = True, rerank: bool = False, k: int = 5) -> str:
    """CTEs up to ``told``, one row for each of the k best records with reasons. ``asked``: SQL of ``(query_id, query, semantic_query)``."""
    graph = GRAPH_CTES[: GRAPH_CTES.index("both_ways AS")].rstrip().rstrip(",").replace(GRAPH_NODE_SQL, "SELECT id, is_number, title, product_category, ord FROM cat").replace(REFERENCE_SQL, "SELECT id AS source, ref FROM cat WHERE ref IS NOT NULL")
    side = f"round({cos_sql('qv.embedding', 'dv.embedding')}, 12)" if semantic else "0.0::DOUBLE"
    text = "concat(is_number, ' ', title, ' ', product_category, ' ', sector, ' ', array_to_string(keywords, ' '), ' ', scope)"
    candidate = "concat('Indian Standard: ', is_number, ' | Title: ', title, ' | Category: ', product_category, ' | Sector: ', sector, ' | Keywords: ', array_to_string(keywords, ', '), ' | Scope: ', scope, CASE WHEN description IS NULL THEN '' ELSE ' | Description: ' || description[:200] END)"
    words = lambda c: f"list_filter(list_distinct(string_split(lower({c}), ' ')), lambda w: w <> '')"
    score = f"8 * len(list_intersect({words('semantic_query')}, {words(candidate)})) / len({words('semantic_query')}) - 4.05"
    final = (
        f"""pooled AS (SELECT h.*, CASE WHEN hybrid_rank <= 10 THEN (SELECT {score} FROM cat WHERE cat.id = h.id) END AS raw FROM (SELECT * FROM hyb JOIN req USING (query_id) WHERE hybrid_rank <= {10 + k}) h),
fin AS (SELECT query_id, id, bm25_raw, bm25_norm, semantic_raw, semantic_norm, relevance_score AS hybrid_score, hybrid_rank, raw IS NOT NULL AS reranked, CASE WHEN raw IS NOT NULL THEN round(1 / (1 + exp(-raw)), 4) END AS ce,
  CASE WHEN raw IS NOT NULL THEN round(0.5 / (1 + exp(-raw)) + 0.5 * relevance_score, 4) ELSE relevance_score END AS relevance_score FROM pooled)"""
        if rerank
        else "fin AS (SELECT query_id, id, bm25_raw, bm25_norm, semantic_raw, semantic_norm, relevance_score AS hybrid_score, hybrid_rank, false AS reranked, NULL::DOUBLE AS ce, relevance_score FROM hyb)"
    )
    return f"""cat AS MATERIALIZED ({FULL_DUCK}), req AS MATERIALIZED ({asked}),
cd AS (SELECT id, {tokens_sql(text)} AS t FROM cat),
cpost AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM cd) GROUP BY ALL),
cstats AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM cd),
cidf AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM cpost, cstats GROUP BY term),
cq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM req) GROUP BY ALL),
csc AS (SELECT query_id, p.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / greatest(avgdl, 1)))) AS b FROM cq JOIN cpost p USING (term) JOIN cidf USING (term) JOIN cd ON p.id = cd.id, cstats GROUP BY ALL),
nv AS (SELECT count(*) AS m FROM embeddings),
qv AS (SELECT query_id, embedding FROM req, nv JOIN embeddings ON vec_id = (query_id * 7) % m), dv AS (SELECT id, embedding FROM cat, nv JOIN embeddings ON vec_id = ord % m),
every AS (SELECT req.query_id, cat.id, coalesce(b, 0) AS b, {side} AS s, b IS NOT NULL OR {str(semantic).lower()} AS candidate FROM req CROSS JOIN cat JOIN qv ON qv.query_id = req.query_id JOIN dv ON dv.id = cat.id LEFT JOIN csc ON csc.query_id = req.query_id AND csc.id = cat.id),
lim AS (SELECT *, min(b) OVER w AS b0, max(b) OVER w AS b1, min(s) OVER w AS s0, max(s) OVER w AS s1 FROM every WINDOW w AS (PARTITION BY query_id)),
sca AS (SELECT query_id, id, b, s, CASE WHEN b1 = b0 THEN CASE WHEN b1 > 0 THEN 1 ELSE 0 END ELSE (b - b0) / (b1 - b0) END AS bn, CASE WHEN s1 = s0 THEN CASE WHEN s1 > 0 THEN 1 ELSE 0 END ELSE (s - s0) / (s1 - s0) END AS sn FROM lim WHERE candidate),
hyb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, id) AS hybrid_rank FROM (SELECT query_id, id, round(b, 4) AS bm25_raw, round(bn, 4) AS bm25_norm, round(s, 4) AS semantic_raw, round(sn, 4) AS semantic_norm, round(0.6 * sn + 0.4 * bn, 4) AS relevance_score FROM sca)),
{final},
ranked AS (SELECT *, round_even((CASE WHEN max(relevance_score) OVER (PARTITION BY query_id) > 1e-9 THEN relevance_score / max(relevance_score) OVER (PARTITION BY query_id) * 100 ELSE 0 END)::DOUBLE, 0) AS relative_match_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, reranked DESC, hybrid_rank) AS rank FROM fin) WHERE rank <= {k}),
{CERT_CTE.replace(core.CATALOG_DUCK, "SELECT * FROM cat")},
{graph},
ends AS (SELECT source AS id, target AS neighbour, relationship_type, 0 AS way FROM edges UNION ALL SELECT target, source, relationship_type, 1 FROM edges),
nb AS (SELECT id, neighbour, min(way) AS way, arg_min(relationship_type, way) AS kind FROM ends GROUP BY ALL),
links AS (SELECT nb.id, list({{'way': way, 'id': neighbour, 'said': concat(is_number, ' (', CASE kind WHEN 'RELATED_STANDARD' THEN 'Related standard (prototype corpus)' ELSE 'Same Product Category' END, ')')}} ORDER BY way, neighbour) AS near FROM nb JOIN cat ON cat.id = nb.neighbour GROUP BY nb.id),
am AS (SELECT id, n_amendments AS n, CASE WHEN n_amendments = 0 THEN NULL WHEN n_amendments = 1 OR 2000 + (size + 3) % 20 > 2000 + (size + 6) % 20 THEN 1 ELSE 2 END AS num FROM cat),
ver AS (SELECT id, n, num, CASE WHEN num IS NOT NULL THEN 2000 + (size + 3 * num) % 20 END AS yr, CASE WHEN status = 'Superseded' THEN 'Superseded' WHEN revision_year IS NOT NULL AND n > 0 THEN 'Active — amendments recorded in corpus' WHEN revision_year IS NOT NULL THEN 'Active — latest known revision in corpus' ELSE 'Revision information unavailable' END AS version_status FROM cat JOIN am USING (id)),
full_ AS (SELECT r.*, req.query, req.semantic_query, cat.* EXCLUDE (id), ver.n, ver.num, ver.yr, ver.version_status, ass.match_kind, ass.certification_scheme, ass.indication, ass.source_reference, ass.applicability_basis, coalesce(near, []) AS near, {norm_sql('query')} AS qn, list_sort(list_distinct({tokens_sql('query')})) AS qt
  FROM ranked r JOIN req USING (query_id) JOIN cat ON cat.id = r.id JOIN ver ON ver.id = r.id JOIN ass ON ass.id = r.id LEFT JOIN links ON links.id = r.id),
why AS (SELECT *, [k FOR k IN [lower(x) FOR x IN keywords] IF contains(qn, k) OR len([t FOR t IN qt IF contains(k, t)]) > 0] AS mk, [t FOR t IN qt IF list_contains({tokens_sql('product_category')}, t)] AS mc, [t FOR t IN qt IF list_contains({tokens_sql('sector')}, t)] AS ms, [t FOR t IN qt IF list_contains({tokens_sql('scope')}, t)] AS mp FROM full_),
scored AS (SELECT *, [x FOR x IN [
  CASE WHEN len(mc) > 0 THEN concat('Product category match: ''', product_category, ''' (matched ''', array_to_string(mc, ', '), ''')') WHEN len(ms) > 0 THEN concat('Engineering sector alignment: ''', sector, '''') END,
  CASE WHEN len(mk) > 0 THEN concat('Matched standard keywords: ', array_to_string(mk[1:3], ', ')) END,
  CASE WHEN len(mp) >= 2 THEN concat('High technical scope overlap on terms: ', array_to_string(mp[1:3], ', ')) END,
  CASE WHEN ce IS NOT NULL THEN 'Cross-encoder deep relevance score' WHEN semantic_raw >= 0.5 THEN 'Strong semantic vector contextual similarity' WHEN bm25_norm >= 0.5 THEN 'Strong lexical keyword match density' END,
  CASE WHEN n > 0 THEN concat('Version status: ', version_status, ' (Latest: Amd #', num, ', ', yr, ')') WHEN coalesce(revision_year, 0) <> 0 THEN concat('Revision year: ', revision_year, ' (', version_status, ')') END,
  CASE WHEN indication = 'candidate certification requirement' THEN concat('Certification scheme: ', certification_scheme, ' (candidate requirement in prototype rules)') END] IF x IS NOT NULL] AS reasons0 FROM why),
told AS (SELECT *, CASE WHEN len(reasons0) > 0 THEN reasons0 ELSE ['General semantic & technical scope relevance match'] END AS reasons FROM scored)"""


ASKED = f"SELECT query_id, query, query AS semantic_query FROM ({REQUEST_SQL})"
COLUMNS = "query_id, CAST(rank AS INT) AS rank, id AS doc_id, bm25_raw, bm25_norm, semantic_raw, semantic_norm, hybrid_score, relevance_score, relative_match_score, version_status, match_kind, CAST(len(near) AS BIGINT) AS n_neighbours, array_to_string([x.id FOR x IN near], ',') AS neighbours, array_to_string(reasons, '; ') AS reasons"


def plain(c: str = "reasons"):
    """Reasons without the figures of scores, whose digits the engines write differently."""
    return F.transform(c, lambda r: F.regexp_replace(r, r"( \(BM25 normalized score: .*\)|: \d\.\d\d| \(\d+%\))$", ""))


def told(ranked: DataFrame, *more) -> DataFrame:
    near = F.transform("neighbours", lambda x: x["standard_id"])
    return ranked.select(
        "query_id", "rank", "doc_id", "bm25_raw", "bm25_norm", "semantic_raw", "semantic_norm", "hybrid_score", "relevance_score", "relative_match_score", "version_status", "match_kind",
        F.size("neighbours").cast("long").alias("n_neighbours"), joined(near, ",").alias("neighbours"), joined(plain()).alias("reasons"), *more,
    )


@query(f"WITH {ranked_sql(ASKED)} SELECT {COLUMNS} FROM told")
def recommend_hybrid(spark, sf):
    """Both sides, with amendments and neighbours."""
    return told(pipelines.recommend(full_requests(spark, sf), full_catalog(spark, sf), 5))


@query(f"WITH {ranked_sql(ASKED, rerank=True)} SELECT {COLUMNS}, ce AS cross_encoder_norm, reranked FROM told")
def recommend_reranked(spark, sf):
    """The same with a pair scorer over a pool of ten."""
    return told(pipelines.recommend(full_requests(spark, sf), full_catalog(spark, sf), 5, pair_scorer), "cross_encoder_norm", "reranked")


#: Requests in document form: for each supplier's part the last specification text written for it, with queries built from what was extracted.
SPEC_OF = "(SELECT l_partkey AS query_id, max(l_orderkey * 100 + l_linenumber) AS spec FROM lineitem GROUP BY 1)"
ASKED_BY_REQUIREMENTS = f"SELECT r.query_id, b.keyword_query AS query, b.semantic_query FROM ({REQUEST_SQL}) r JOIN {SPEC_OF} s USING (query_id) JOIN ({ORACLES['build_query']}) b ON b.query_id = s.spec"


def requirement_requests(spark, sf) -> DataFrame:
    return with_vector(spark, sf, core.gap_requests(spark, sf), "query_id", 7)


@query(f"WITH {ranked_sql(ASKED_BY_REQUIREMENTS, rerank=True)} SELECT {COLUMNS}, ce AS cross_encoder_norm, reranked FROM told")
def recommend_by_requirements(spark, sf):
    asked = requirement_requests(spark, sf).drop("query")
    return told(pipelines.recommend_from_requirements(asked, full_catalog(spark, sf), 5, pair_scorer), "cross_encoder_norm", "reranked")


@query(f"""WITH {ranked_sql(ASKED)}, st AS (SELECT query_id, attributes FROM ({core.GAP_REQ_SQL}))
SELECT t.query_id, count(*) AS total_standards_evaluated, string_agg(concat(id, ':', array_to_string(mk, ','), ':', array_to_string([concat(a.a, '=', a.v, '|', a.u, '|', a.s) FOR a IN attributes], ','), ':standards.json (demo corpus)|VersionAmendmentAnalyzer (corpus metadata)', CASE WHEN len(near) > 0 THEN '|StandardsGraphBuilder (NetworkX graph)' ELSE '' END, '|CertificationRuleEngine (', source_reference, ')'), '; ' ORDER BY rank) AS evidence
FROM told t JOIN st USING (query_id) GROUP BY t.query_id""")
def evidence_stated(spark, sf):
    """Evidence with the attributes that requests state, and neighbours as a source."""
    requests = requirement_requests(spark, sf)
    ranked = pipelines.recommend(requests.drop("requirements"), full_catalog(spark, sf), 5)
    stated = ranked.join(requests.select("query_id", F.col("requirements.technical_requirements").alias("stated")), "query_id")
    got = evidence.package(evidence.add_evidence(stated, attributes=F.col("stated")), ["rank", "doc_id", "matched_keywords", "matched_technical_requirements", "provenance_sources"])
    attributes = lambda e: F.transform(e["matched_technical_requirements"], lambda a: F.concat(a["attribute"], F.lit("="), a["value"], F.lit("|"), a["unit"], F.lit("|"), a["source_text"]))
    say = F.transform("standards_evidence", lambda e: F.concat(e["doc_id"], F.lit(":"), F.array_join(e["matched_keywords"], ","), F.lit(":"), F.array_join(attributes(e), ","), F.lit(":"), F.array_join(e["provenance_sources"], "|")))
    return got.select("query_id", "total_standards_evaluated", joined(say).alias("evidence"))


_TOLD_NOTE = "CASE WHEN indication = 'candidate certification requirement' THEN concat('Candidate certification mapping identified under ''', certification_scheme, ''' (', source_reference, '). Authoritative BIS/QCO verification required.') ELSE concat(applicability_basis, ' Authoritative BIS/QCO verification required.') END"


@query(f"""WITH {ranked_sql(ASKED)} SELECT query_id, CAST(rank AS INT) AS rank, CASE WHEN len(near) > 0 THEN concat('Connected in Standards Network to: ', array_to_string([x.said FOR x IN near[1:3]], ', '), '.') WHEN ref IS NOT NULL THEN concat('Cross-references related standards: ', ref, '.') END AS related_standards_explanation,
  CASE WHEN n > 0 THEN concat(coalesce(CAST(revision_year AS VARCHAR), 'Recorded'), ' revision with ', n, ' amendment(s) (Latest: Amd #', num, ', ', yr, ') recorded in available prototype corpus. Authoritative BIS verification required.') ELSE concat(coalesce(CAST(revision_year AS VARCHAR), 'Recorded'), ' revision (', version_status, '). Authoritative BIS verification required.') END AS version_note, {_TOLD_NOTE} AS certification_note FROM told""")
def explanations_linked(spark, sf):
    """Explanations by neighbours, amendments and certification."""
    return pipelines.explained(pipelines.recommend(full_requests(spark, sf), full_catalog(spark, sf), 5)).select("query_id", "rank", "related_standards_explanation", "version_note", "certification_note")


# --- O: reports with links and requirements -----------------------------------------------------------------------

GAP_TAIL = core.GAP_CTES[len(core.RANKED_CTES) :]


def report_sql(asked: str) -> str:
    return f"""WITH {ranked_sql(asked)}{GAP_TAIL}, gs AS (SELECT query_id, count(*) AS n, count(*) FILTER (status = 'covered') AS c FROM cov GROUP BY query_id)
SELECT g.query_id, concat('REP-20240101-', upper(sha256(CAST(g.query_id AS VARCHAR))[:6])) AS report_id, raw_text[:500] AS snippet, any_value(name) AS product, CAST(any_value(len(attributes)) AS BIGINT) AS n_attributes, string_agg(t.id, '; ' ORDER BY rank) AS recommendations,
  string_agg(concat(t.id, ':', t.version_status), '; ' ORDER BY rank) AS versions, any_value(gs.n) AS total_requirements, any_value(gs.c) AS covered_count, CAST(len(list_distinct(flatten(list(t.near)))) AS BIGINT) AS n_links
FROM gr g JOIN told t USING (query_id) JOIN gs USING (query_id) GROUP BY g.query_id, raw_text"""


def report_rows(spark, sf, by_requirements: bool) -> DataFrame:
    got = pipelines.reports(requirement_requests(spark, sf), full_catalog(spark, sf), 5, day=F.lit("2024-01-01").cast("date"), by_requirements=by_requirements)
    r = F.col("extracted_requirements")
    return got.select(
        "query_id", "metadata.report_id", F.col("input_requirement.raw_text_snippet").alias("snippet"), r["product"]["name"].alias("product"), F.size(r["technical_requirements"]).cast("long").alias("n_attributes"), joined(F.transform("recommendations", lambda x: x["doc_id"])).alias("recommendations"),
        joined(F.transform("version_intelligence", lambda x: F.concat(x["doc_id"], F.lit(":"), x["version_status"]))).alias("versions"), "gap_analysis.total_requirements", "gap_analysis.covered_count", F.size("network_information").cast("long").alias("n_links"),
    )


@query(report_sql(ASKED))
def report_linked(spark, sf):
    return report_rows(spark, sf, False)


@query(report_sql(ASKED_BY_REQUIREMENTS))
def report_by_requirements(spark, sf):
    return report_rows(spark, sf, True)


@query(f"WITH {ranked_sql(ASKED)} SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids FROM told GROUP BY query_id")
def report_json(spark, sf):
    """Recommended ids, read back from reports that were written as JSON."""
    written = sinks.write_reports(pipelines.reports(requirement_requests(spark, sf), full_catalog(spark, sf), 5, day=F.lit("2024-01-01").cast("date")), shared.new_path(spark, "reports"))
    rows = sinks.read_reports(spark, written)
    ids = F.from_json(F.get_json_object("report", "$.recommendations"), "array<struct<rank: int, doc_id: string>>")
    return rows.select("query_id", joined(F.transform(ids, lambda x: x["doc_id"]), ",").alias("ids"))


# --- N9, N5, A15: four systems compared ---------------------------------------------------------------------------

#: A request's own part is relevant, and more so than those of its category.
RELEVANT_SQL = "SELECT r.query_id, c.id AS doc_id, CASE WHEN c.ord = r.query_id THEN 2 ELSE 1 END AS rel FROM req r JOIN cat o ON o.ord = r.query_id JOIN cat c ON c.product_category = o.product_category"
_ALL = [*[f"coalesce(count(*) FILTER (rel > 0 AND rank <= {k}) / {k}, 0) AS p_at_{k}, coalesce(count(*) FILTER (rel > 0 AND rank <= {k}) / any_value(n_rel), 0) AS r_at_{k}" for k in evaluate.PLACES], "coalesce(max(1 / rank) FILTER (rel > 0 AND rank <= 5), 0) AS mrr", "coalesce(max(1 / rank) FILTER (rel > 0), 0) AS mrr_any", *[f"coalesce(sum((pow(2, rel) - 1) / log2(rank + 1)) FILTER (rel > 0 AND rank <= {k}) / any_value(i{k}), 0) AS ndcg_at_{k}" for k in evaluate.NDCG_AT]]
SYSTEM_CTES = f"""{ranked_sql(ASKED, rerank=True, k=14)},
ran AS (SELECT 'bm25' AS system, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC, id) AS rank FROM csc UNION ALL SELECT 'dense', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) FROM every
  UNION ALL SELECT 'hybrid', query_id, id, hybrid_rank FROM hyb UNION ALL SELECT 'reranked', query_id, id, rank FROM ranked),
rels AS ({RELEVANT_SQL}), top AS (SELECT ran.system, ran.query_id, ran.rank, coalesce(rels.rel, 0) AS rel FROM ran LEFT JOIN rels ON rels.query_id = ran.query_id AND rels.doc_id = ran.id WHERE ran.rank <= 14),
ideal AS (SELECT query_id, count(*) AS n_rel, sum((pow(2, rel) - 1) / log2(i + 1)) FILTER (i <= 3) AS i3, sum((pow(2, rel) - 1) / log2(i + 1)) FILTER (i <= 5) AS i5 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS i FROM rels) GROUP BY query_id),
per AS (SELECT system, query_id, {', '.join(_ALL)} FROM top LEFT JOIN ideal USING (query_id) GROUP BY ALL)"""


def systems(spark, sf, mrr_at: int | None = evaluate.MRR_AT) -> DataFrame:
    """Metrics of each system and request."""
    asked, catalog = full_requests(spark, sf), full_catalog(spark, sf, linked=False)
    q, c = asked.select("query_id", F.concat(F.lit("P-"), F.col("query_id").cast("string")).alias("own")), catalog.records.select("id", "product_category")
    own = q.join(shared.by_key(c), F.col("own") == F.col("id")).select("query_id", "own", "product_category")
    relevant = own.join(shared.by_key(c), "product_category").select("query_id", F.col("id").alias("doc_id"), F.when(F.col("id") == F.col("own"), 2).otherwise(1).alias("rel"))
    return evaluate.per_query(pipelines.systems(asked, catalog, pair_scorer), relevant, asked.select("query_id"), mrr_at)


@query(f"WITH {SYSTEM_CTES} SELECT system, count(*) AS n_queries, {core.MEANS_SQL} FROM per GROUP BY system")
def systems_compared(spark, sf):
    return evaluate.by_system(systems(spark, sf))


@query(f"WITH {SYSTEM_CTES} SELECT system, query_id, round(mrr_any, 6) AS mrr FROM per")
def mrr_any_place(spark, sf):
    """Reciprocal rank of the first relevant record wherever it is."""
    return systems(spark, sf, None).select("system", "query_id", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {SYSTEM_CTES} SELECT 'aggregate' AS part, system, '' AS query_id, round(avg(ndcg_at_3), 4) AS ndcg_at_3 FROM per GROUP BY system UNION ALL SELECT 'queries', system, CAST(query_id AS VARCHAR), round(ndcg_at_3, 4) FROM per")
def evaluation_written(spark, sf):
    """Results as they are read back from the written evaluation."""
    rows = shared.stored(systems(spark, sf), "metrics")
    path = shared.new_path(spark, "evaluation")
    sinks.write_evaluation(evaluate.by_system(rows), evaluate.by_group(rows.withColumn("language", F.lit("en"))), rows, path)
    read = lambda part, who: spark.read.json(f"{path}/{part}").select(F.lit(part).alias("part"), "system", who.alias("query_id"), F.round("ndcg_at_3", 4).alias("ndcg_at_3"))
    return read("aggregate", F.lit("")).unionByName(read("queries", F.col("query_id").cast("string")))


# --- P6: requests as a stream -------------------------------------------------------------------------------------


@query(ORACLES["recommend_hybrid"])
def stream_recommend(spark, sf):
    """The requests as a stream of several batches, ranked batch by batch; what was appended is read back."""
    at, catalog = shared.new_path(spark, "requests"), full_catalog(spark, sf)
    full_requests(spark, sf).repartition(3).write.parquet(f"{at}/in")
    enrich.recommend_stream(enrich.arriving(spark, f"{at}/in", 2), catalog, f"{at}/out", f"{at}/state", columns=told).trigger(availableNow=True).start().awaitTermination()
    return enrich.ranked_so_far(spark, f"{at}/out")
