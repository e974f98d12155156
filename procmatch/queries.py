"""The operators as registered queries over the driver's tables, and the same in SQL.

Star-schema tables stand for what the engine works on: parts are records, lines of an order refer to each other, orders have lines as amendments,
specification texts are written from parts and lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmatch.functions import extract, querytext, text
from procmatch.operators import certify, containment, dense, evaluate, evidence, fusion, gaps, hybrid, impact, lexical, network, report, sync, versions
from procmatch.plans import pipelines
from procmatch.sources import corpus, shared, sinks
from procmatch.streaming import enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as there are cores, where a small file has fewer; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def joined(c, sep: str = "; "):
    return F.array_join(c, sep)


# --- Derived tables, in both forms -------------------------------------------------------------------------------

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"[t FOR t IN string_split({norm_sql(c)}, ' ') IF length(t) > 1 AND t NOT IN {STOP_SQL}]"


SPEC_COLS = ["l_orderkey", "l_linenumber", "l_partkey"]
SPEC_SQL = """SELECT l_orderkey, l_linenumber, l_partkey,
  concat('Supply of ', CASE l_partkey % 5 WHEN 0 THEN 'Distribution Transformer' WHEN 1 THEN 'LED street light' WHEN 2 THEN 'HDPE pipe' WHEN 3 THEN 'Portland slag cement' ELSE p_name END, ' type ', lower(p_type), chr(10),
    'size ', p_size, ' mm, ', p_size * 10, ' V, 50 Hz, rating ', CAST(l_quantity AS INT), ' kVA, IP', 50 + p_size % 20, ', is ', 1000 + p_partkey % 50, ' : 2012 and IS ', 1000 + l_suppkey % 50, chr(10),
    'Outdoor installation with earthing, ', CASE l_returnflag WHEN 'A' THEN 'pole mounting' WHEN 'N' THEN 'surge protection 10 kV surge' ELSE 'efficiency 98%' END, chr(10),
    'Dielectric insulation test for ', p_size, ' mm at ', p_size, ' mm') AS text
FROM lineitem JOIN part ON l_partkey = p_partkey"""
CATALOG_SQL = """SELECT concat('P-', p_partkey) AS id, concat('IS ', 1000 + p_partkey, ' : ', 1990 + p_size % 30) AS is_number, p_name AS title,
  concat('Covers ', p_name, ' of size ', p_size, ' mm in ', lower(p_type), ' grade') AS scope, p_type AS sector, p_brand AS product_category,
  {list}(split_part(p_name, ' ', 1), lower(p_type), concat('size ', p_size)) AS keywords,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1990 + p_size % 30 END AS revision_year, CASE WHEN p_partkey % 9 = 0 THEN 'Superseded' ELSE 'Active (DEMO / SAMPLE DATA)' END AS status,
  CASE WHEN p_partkey % 3 = 0 THEN concat('Rated ', p_size * 10, ' V, 50 Hz') END AS description, p_partkey AS ord
FROM part"""
#: Requests, one for each supplier, for the part of the same number.
REQUEST_SQL = """SELECT s_suppkey AS query_id, concat('Supply of ', p_name, ' in ', lower(p_type), ' grade, size ', p_size, ' mm, ', p_size * 10, ' V, IS ', 1000 + p_partkey) AS query
FROM supplier JOIN part ON s_suppkey = p_partkey"""


def with_views(spark: SparkSession, sf: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names}) if names else spark.sql(sql)


def specs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SPEC_SQL.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), lineitem=spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")), part=table(spark, sf, "part"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(CATALOG_SQL.replace("{list}", "array").replace("FROM part", "FROM {part}"), part=spread(table(spark, sf, "part")))
    none = F.array().cast("array<string>")
    return rows.withColumns({"amendments": none, "related_standards": none, "source_url": F.lit(None).cast("string")})


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(REQUEST_SQL.replace("FROM supplier JOIN part", "FROM {supplier} JOIN {part}"), supplier=table(spark, sf, "supplier"), part=table(spark, sf, "part"))


CATALOG_DUCK = CATALOG_SQL.replace("{list}", "list_value")

# --- B: text ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS normalized_md5, CAST(length({norm_sql('text')}) AS BIGINT) AS n FROM documents")
def normalize_text(spark, sf):
    n = text.normalize_text(F.col("text"))
    return documents(spark, sf).select("doc_id", F.md5(n.cast("binary")).alias("normalized_md5"), F.length(n).cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def token_counts(spark, sf):
    t = documents(spark, sf).select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(joined("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"""SELECT id, concat(is_number, ' ', title, ' ', product_category, ' ', sector, ' ', array_to_string(keywords, ' '), ' ', scope) AS document_text,
  trim(concat(is_number, ' ', title, ' ', product_category, ' ', sector, ' ', array_to_string(keywords, ' '), ' ', scope, CASE WHEN description IS NULL THEN '' ELSE ' ' || description END)) AS embedding_content,
  concat('Indian Standard: ', is_number, ' | Title: ', title, ' | Category: ', product_category, ' | Sector: ', sector, ' | Keywords: ', array_to_string(keywords, ', '), ' | Scope: ', scope, CASE WHEN description IS NULL THEN '' ELSE ' | Description: ' || description[:200] END) AS candidate_text
FROM ({CATALOG_DUCK})""")
def record_texts(spark, sf):
    return records(spark, sf).select("id", text.document_text().alias("document_text"), text.embedding_content().alias("embedding_content"), text.candidate_text().alias("candidate_text"))


CLEAN_SQL = r"regexp_replace(array_to_string([trim(x, ' ') FOR x IN string_split(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(0), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))], chr(10)), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, md5({CLEAN_SQL}) AS clean_md5 FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.clean_extracted(F.col("text")).cast("binary")).alias("clean_md5"))


@query(f"""WITH p AS (SELECT conv_id, turn, {CLEAN_SQL} AS t FROM conversations)
SELECT conv_id, md5(coalesce(string_agg(concat('--- Page ', turn, ' ---', chr(10), t), chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '')) AS text_md5,
  CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS total_chars, CAST(count(*) FILTER (t <> '') AS BIGINT) AS n_pages, coalesce(sum(length(t)), 0) < 50 AS needs_ocr FROM p GROUP BY conv_id""")
def page_assembly(spark, sf):
    got = text.assemble_pages(table(spark, sf, "conversations"), "conv_id", "turn")
    return got.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "total_chars", "n_pages", "needs_ocr")


#: A dictionary of the benchmark texts' own syllables.
TERMS = [("tion", ["action", "motion"]), ("ing", ["doing"]), ("ción", ["acción", "motion"]), ("keit", ["state", "action"]), ("eau", ["water"]), ("wh", ["which", "doing"])]


@query("WITH d(ord, term, words) AS (VALUES " + ", ".join(f"({i}, '{t}', {w})" for i, (t, w) in enumerate(TERMS)) + """),
w AS (SELECT item_id, word, min(ord * 10 + k) AS place FROM (SELECT item_id, ord, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM benchmark JOIN d ON contains(trim(text), term)) GROUP BY item_id, word)
SELECT b.item_id, CASE WHEN w.more IS NULL THEN trim(text) ELSE trim(text) || ' ' || w.more END AS expanded FROM benchmark b LEFT JOIN (SELECT item_id, string_agg(word, ' ' ORDER BY place) AS more FROM w GROUP BY item_id) w USING (item_id)""")
def query_expansion(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.expand_query(F.col("text"), TERMS).alias("expanded"))


@query(ORACLES["query_expansion"])
def query_expansion_table(spark, sf):
    terms = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(TERMS)], "ord int, term string, words array<string>")
    return containment.expand_by_table(table(spark, sf, "benchmark"), terms, "item_id", "text").select("item_id", "expanded")


# --- C, D: extraction and queries built from it -------------------------------------------------------------------


@query(rf"""SELECT {', '.join(SPEC_COLS)}, array_to_string([m FOR m, i IN ms IF list_position([upper(x) FOR x IN ms], upper(m)) = i], '; ') AS mentions
FROM (SELECT *, [regexp_replace(trim(m), '\s+', ' ', 'g') FOR m IN regexp_extract_all(text, '{extract.MENTION}')] AS ms FROM ({SPEC_SQL}))""")
def is_mentions(spark, sf):
    return specs(spark, sf).select(*SPEC_COLS, joined(extract.is_mentions(F.col("text"))).alias("mentions"))


def _measure_sql(m: extract.Measure) -> str:
    unit = "regexp_extract_all(text, '{p}', 2)".format(p=m.pattern) if m.unit is None else f"['{m.unit}' FOR x IN regexp_extract_all(text, '{m.pattern}')]"
    return f"[{{'a': '{m.attribute}', 'v': z[2], 'u': z[3], 's': trim(z[1])}} FOR z IN list_zip(regexp_extract_all(text, '{m.pattern}'), regexp_extract_all(text, '{m.pattern}', 1), {unit})]"


ATTRIBUTES_SQL = "list_concat([{'a': 'ingress_protection', 'v': upper(replace(m, ' ', '')), 'u': '', 's': trim(m)} FOR m IN regexp_extract_all(text, '" + extract.INGRESS + "')], " + ", ".join(_measure_sql(m) for m in extract.MEASURES) + ")"
SPEC_ATTRIBUTES_SQL = f"SELECT *, [x FOR x, i IN every IF list_position([y.s FOR y IN every], x.s) = i] AS attributes FROM (SELECT *, {ATTRIBUTES_SQL} AS every FROM ({SPEC_SQL}))"


@query(f"SELECT {', '.join(SPEC_COLS)}, array_to_string([concat(x.a, '=', x.v, '|', x.u, '|', x.s) FOR x IN attributes], '; ') AS attributes FROM ({SPEC_ATTRIBUTES_SQL})")
def tech_attributes(spark, sf):
    a = F.transform(extract.technical_attributes(F.col("text")), lambda x: F.concat(x["attribute"], F.lit("="), x["value"], F.lit("|"), text.blank(x["unit"]), F.lit("|"), x["source_text"]))
    return specs(spark, sf).select(*SPEC_COLS, joined(a).alias("attributes"))


def _clauses_sql(terms: list[str]) -> str:
    return "list_slice([x FOR x, i IN ls IF list_position(ls, x) = i], 1, 5) FROM (SELECT *, [x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> '' AND length(x) < 300 AND (" + " OR ".join(f"contains(lower(x), '{t}')" for t in terms) + ")] AS ls"


@query(f"SELECT {', '.join(SPEC_COLS)}, array_to_string(c, '; ') AS clauses FROM (SELECT {', '.join(SPEC_COLS)}, {_clauses_sql(extract.SAFETY_TERMS).replace(' FROM', ' AS c FROM', 1)} FROM ({SPEC_SQL})))")
def clauses_safety(spark, sf):
    return specs(spark, sf).select(*SPEC_COLS, joined(extract.safety_clauses(F.col("text"))).alias("clauses"))


@query(f"SELECT {', '.join(SPEC_COLS)}, array_to_string(c, '; ') AS clauses FROM (SELECT {', '.join(SPEC_COLS)}, {_clauses_sql(extract.INSTALLATION_TERMS).replace(' FROM', ' AS c FROM', 1)} FROM ({SPEC_SQL})))")
def clauses_install(spark, sf):
    return specs(spark, sf).select(*SPEC_COLS, joined(extract.installation_clauses(F.col("text"))).alias("clauses"))


PRODUCT_CASES = [(c, k) for c, ks in extract.PRODUCTS for k in ks]


def _product_sql(what: int, other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{(k.title(), c)[what]}'" for c, k in PRODUCT_CASES) + f" ELSE {other} END"


FIRST_LINE_SQL = r"[trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> '' AND NOT starts_with(x, '---')][1]"
NAME_SQL, CATEGORY_SQL = _product_sql(0, f"CASE WHEN length({FIRST_LINE_SQL}) < 100 THEN {FIRST_LINE_SQL} END"), _product_sql(1, "NULL")


@query(f"SELECT {', '.join(SPEC_COLS)}, {NAME_SQL} AS name, {CATEGORY_SQL} AS category FROM ({SPEC_SQL})")
def product_id(spark, sf):
    return specs(spark, sf).select(*SPEC_COLS, extract.product(F.col("text")).alias("p")).select(*SPEC_COLS, "p.name", "p.category")


KEYWORDS_SQL = """SELECT {id}, list(word ORDER BY rank) AS keywords FROM (
  SELECT {id}, word, row_number() OVER (PARTITION BY {id} ORDER BY count(*) DESC, min(pos)) AS rank FROM (
    SELECT {id}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT {id}, string_split({norm}, ' ') AS ws FROM {source}))
  WHERE length(word) > 2 AND word NOT IN {stop} AND NOT regexp_full_match(word, '\\p{{Nd}}+') GROUP BY {id}, word) WHERE rank <= 10 GROUP BY {id}"""


@query("SELECT doc_id, array_to_string(keywords, ' ') AS keywords FROM (" + KEYWORDS_SQL.format(id="doc_id", norm=norm_sql("text"), source="documents", stop=STOP_SQL) + ")")
def keywords_top10(spark, sf):
    return text.keywords_of(documents(spark, sf)).select("doc_id", joined("keywords", " ").alias("keywords"))


#: Specification texts of suppliers' parts, with requirements; for requests in document form.
REQ_SPEC_SQL = f"SELECT l_orderkey * 100 + l_linenumber AS query_id, max(text) AS text FROM ({SPEC_SQL}) GROUP BY 1"
REQUIREMENTS_SQL = f"""SELECT r.*, keywords, {NAME_SQL} AS name, {CATEGORY_SQL} AS category,
  [x FOR x, i IN every IF list_position([y.s FOR y IN every], x.s) = i] AS attributes, [m FOR m, i IN ms IF list_position([upper(x) FOR x IN ms], upper(m)) = i] AS mentions,
  list_slice([x FOR x, i IN safe IF list_position(safe, x) = i], 1, 5) AS safety, list_slice([x FOR x, i IN inst IF list_position(inst, x) = i], 1, 5) AS installation
FROM (SELECT *, {ATTRIBUTES_SQL} AS every, [regexp_replace(trim(m), '\\s+', ' ', 'g') FOR m IN regexp_extract_all(text, '{extract.MENTION}')] AS ms,
  [x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> '' AND length(x) < 300 AND ({' OR '.join(f"contains(lower(x), '{t}')" for t in extract.SAFETY_TERMS)})] AS safe,
  [x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> '' AND length(x) < 300 AND ({' OR '.join(f"contains(lower(x), '{t}')" for t in extract.INSTALLATION_TERMS)})] AS inst
  FROM ({REQ_SPEC_SQL})) r LEFT JOIN ({KEYWORDS_SQL.format(id="query_id", norm=norm_sql("text"), source=f"({REQ_SPEC_SQL})", stop=STOP_SQL)}) USING (query_id)"""
CONTEXT_LIST = "[" + ", ".join(f"'{w}'" for w in querytext.CONTEXT_WORDS) + "]"


def spec_requirements(spark, sf):
    docs = specs(spark, sf).groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("query_id")).agg(F.max("text").alias("text"))
    return extract.extract_requirements(docs, "query_id")


@query(f"""WITH r AS (SELECT *, flatten([[w FOR w IN {CONTEXT_LIST} IF contains(lower(c), w)] FOR c IN list_concat(safety, installation)]) AS ctx0 FROM ({REQUIREMENTS_SQL})),
q AS (SELECT *, [w FOR w, i IN ctx0 IF list_position(ctx0, w) = i] AS ctx, flatten([CASE WHEN a.u = '' THEN [a.v] ELSE [a.v, a.u, a.v || a.u] END FOR a IN attributes]) AS parts FROM r)
SELECT query_id, concat_ws(' ', name, CASE WHEN category IS NOT NULL AND NOT contains(lower(name), lower(category)) THEN category END, nullif(array_to_string(mentions, ' '), ''), nullif(array_to_string(parts, ' '), ''), nullif(array_to_string(keywords, ' '), ''), nullif(array_to_string(ctx, ' '), '')) AS keyword_query,
  concat_ws(' ', concat('Technical specification for ', CASE WHEN category IS NOT NULL THEN concat(name, ' in category ', category) ELSE name END, '.'),
    CASE WHEN len(attributes) > 0 THEN concat('Key technical parameters: ', array_to_string([concat_ws(' ', concat(a.a, ': ', a.v), nullif(a.u, '')) FOR a IN attributes], ', '), '.') END,
    CASE WHEN len(ctx) > 0 THEN concat('Operating environment and safety requirements: ', array_to_string(ctx, ', '), '.') END,
    CASE WHEN len(mentions) > 0 THEN concat('Referenced Indian Standards: ', array_to_string(mentions, ', '), '.') END,
    CASE WHEN len(keywords) > 0 THEN concat('Keywords: ', array_to_string(list_slice(keywords, 1, 5), ', '), '.') END) AS semantic_query,
  concat_ws(' ', name, CASE WHEN len(attributes) > 0 THEN concat('(', array_to_string([concat(a.v, a.u) FOR a IN list_slice(attributes, 1, 3)], ', '), ')') END) AS display_query,
  concat_ws(' ', name, nullif(array_to_string([a.s FOR a IN list_slice(attributes, 1, 3)], ' '), ''), nullif(array_to_string(mentions, ' '), '')) AS suggested, text[:500] AS snippet
FROM q""")
def build_query(spark, sf):
    r = F.col("requirements")
    return spec_requirements(spark, sf).select("query_id", querytext.keyword_query(r).alias("keyword_query"), querytext.semantic_query(r).alias("semantic_query"), querytext.display_query(r).alias("display_query"), text.suggested_query(r, F.col("text")).alias("suggested"), text.input_snippet(F.col("text"), F.lit("")).alias("snippet"))


# --- E: lexical search --------------------------------------------------------------------------------------------

BM25_CTES = f"""d AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(len(t)) / greatest(count(*), 1) AS avgdl FROM d),
idf AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post, stats GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / greatest(avgdl, 1)))) AS score FROM q JOIN post p USING (term) JOIN idf USING (term) JOIN d ON p.doc_id = d.doc_id, stats GROUP BY ALL)"""


def doc_index(spark, sf, idf="plus_one"):
    return lexical.build_index(shared.stored(documents(spark, sf).select("doc_id", text.tokenize(F.col("text")).alias("tokens")), "tokens"), idf=idf)


def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), text.tokenize(F.col("text")).alias("tokens"))


def doc_scores(spark, sf, idf="plus_one"):
    return lexical.score(doc_index(spark, sf, idf), benchmark_queries(spark, sf))


@query(f"WITH {BM25_CTES} SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl, n FROM idf, stats")
def bm25_index_stats(spark, sf):
    i = doc_index(spark, sf)
    return i.terms.join(F.broadcast(i.stats)).select("term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"), "n")


@query(f"WITH {BM25_CTES} SELECT query_id, doc_id, round(score, 4) AS score FROM scores")
def bm25_scores(spark, sf):
    return doc_scores(spark, sf).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"""WITH {BM25_CTES}, raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM idf, stats), eps AS (SELECT avg(raw) * 0.25 AS floor FROM raw), okapi AS (SELECT term, CASE WHEN raw < 0 THEN floor ELSE raw END AS w FROM raw, eps)
SELECT query_id, p.doc_id, round(sum(qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / greatest(avgdl, 1)))), 4) AS score FROM q JOIN post p USING (term) JOIN okapi USING (term) JOIN d ON p.doc_id = d.doc_id, stats GROUP BY query_id, p.doc_id""")
def bm25_okapi(spark, sf):
    return doc_scores(spark, sf, "okapi").select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {BM25_CTES} SELECT b.item_id AS query_id, d.doc_id, round(coalesce(score, 0), 4) AS score FROM benchmark b CROSS JOIN d LEFT JOIN scores s ON s.query_id = b.item_id AND s.doc_id = d.doc_id")
def bm25_dense_scores(spark, sf):
    return lexical.score(doc_index(spark, sf), benchmark_queries(spark, sf), every=True).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {BM25_CTES} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 10")
def bm25_topk(spark, sf):
    return impact.search(impact.build(doc_index(spark, sf)), benchmark_queries(spark, sf), 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


# --- F: vectors ---------------------------------------------------------------------------------------------------

UNIT_SQL = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


def cos_sql(a: str, b: str) -> str:
    return f"greatest(0, least(1, {UNIT_SQL.format(a=a, b=b)}))"


COS_CTE = f"cs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, round({cos_sql('q.embedding', 'd.embedding')}, 12) AS score, round({cos_sql('q.embedding[1:32]', 'd.embedding[1:32]')}, 12) AS half FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(spark, sf):
    """The stated query set: every row whose id 50 divides."""
    return vectors(spark, sf).where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


def halves(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.slice("embedding", 1, 32))


@query(f"WITH {COS_CTE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 10")
def cosine_topk(spark, sf):
    return dense.search(vector_queries(spark, sf), vectors(spark, sf), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {COS_CTE} SELECT query_id, doc_id, round(score, 6) AS score FROM cs")
def cosine_pairs(spark, sf):
    return dense.search_pairs(vector_queries(spark, sf), vectors(spark, sf)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {COS_CTE} SELECT query_id, dl AS doc_id, max(round(score, 6)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dl, doc_id) AS rank FROM cs WHERE doc_id % 3 <> 0) WHERE rank <= 40 GROUP BY ALL")
def vector_chunk_max(spark, sf):
    chunks = table(spark, sf, "embeddings").select(F.col("label").alias("standard_id"), F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("vec_id") % 3 == 0, "other").otherwise("own").alias("embedding_model"), F.size("embedding").alias("embedding_dimension"))
    return dense.search_chunks(vector_queries(spark, sf), chunks, "own", 64, 40).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 9) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first, round(list_sum(v) / sqrt(list_dot_product(v, v)), 9) AS total FROM (SELECT vec_id, [x * (1 + vec_id % 7) FOR x IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings)")
def l2_normalize(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("v")).withColumn("u", dense.l2_normalize(F.col("v")))
    return v.select("vec_id", F.round(dense.norm(F.col("v")), 9).alias("norm"), F.round(F.col("u")[0], 9).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, b: a + b), 9).alias("total"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'missing' WHEN vec_id % 10 = 1 THEN 'dimension_mismatch' END AS reject_reason, CASE WHEN vec_id % 10 = 0 THEN 'fallback_bm25' ELSE 'active' END AS semantic_status FROM embeddings")
def dimension_check(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 == 1, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 != 0, F.col("embedding")))
    return dense.check_dimension(v, 64).select("vec_id", "reject_reason", dense.semantic_status(F.col("embedding")).alias("semantic_status"))


@query()
def tfidf_vectors(spark, sf):
    """Hashed; compared with brute force in the tests."""
    return dense.tfidf_vectors(table(spark, sf, "documents"), 128)


def letter_encoder():
    """A toy encoder: shares of 26 letters."""
    import numpy as np

    return lambda texts: np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float)


@query("SELECT item_id, [" + ", ".join(f"coalesce(round(CAST(CAST((length(t) - length(replace(t, '{chr(97 + i)}', ''))) / nullif(n, 0) AS FLOAT) AS DOUBLE), 5), 0)" for i in range(26)) + "][1:3] AS head FROM (SELECT *, sqrt(" + " + ".join(f"pow(length(t) - length(replace(t, '{chr(97 + i)}', '')), 2)" for i in range(26)) + ") AS n FROM (SELECT item_id, lower('query: ' || trim(text)) AS t FROM benchmark))")
def encode_queries(spark, sf):
    got = dense.encode(table(spark, sf, "benchmark"), letter_encoder, prefix="query: ", dimension=26)
    return got.select("item_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 5)).alias("head"))


# --- G: fusion ----------------------------------------------------------------------------------------------------

FUSE_CTES = f"""{BM25_CTES}, nv AS (SELECT count(*) AS m FROM embeddings),
qv AS (SELECT item_id AS query_id, embedding FROM benchmark, nv JOIN embeddings ON vec_id = (item_id * 7) % m),
dv AS (SELECT doc_id, embedding FROM documents, nv JOIN embeddings ON vec_id = doc_id % m),
sem AS (SELECT query_id, doc_id, round({cos_sql('qv.embedding', 'dv.embedding')}, 12) AS score FROM qv, dv),
every AS (SELECT query_id, doc_id, coalesce(s.score, 0) AS b, sem.score AS s FROM sem LEFT JOIN scores s USING (query_id, doc_id)),
lim AS (SELECT *, min(b) OVER w AS b0, max(b) OVER w AS b1, min(s) OVER w AS s0, max(s) OVER w AS s1 FROM every WINDOW w AS (PARTITION BY query_id)),
scaled AS (SELECT query_id, doc_id, b, s, CASE WHEN b1 = b0 THEN CASE WHEN b1 > 0 THEN 1 ELSE 0 END ELSE (b - b0) / (b1 - b0) END AS bn, CASE WHEN s1 = s0 THEN CASE WHEN s1 > 0 THEN 1 ELSE 0 END ELSE (s - s0) / (s1 - s0) END AS sn FROM lim),
fused AS (SELECT query_id, doc_id, round(b, 4) AS bm25_raw, round(bn, 4) AS bm25_norm, round(s, 4) AS semantic_raw, round(sn, 4) AS semantic_norm, round(0.6 * sn + 0.4 * bn, 4) AS relevance_score FROM scaled),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, doc_id) AS hybrid_rank FROM fused)"""


def with_vector(spark, sf, df: DataFrame, key: str, step: int) -> DataFrame:
    """``df`` with a vector of the table of vectors, dealt by its key."""
    v = vectors(spark, sf).select(F.col("doc_id").alias("vec"), "embedding")
    m = F.broadcast(v.agg(F.count("*").alias("m")))
    return df.join(m).withColumn("vec", F.pmod(F.col(key) * step, F.col("m"))).join(v, "vec").drop("vec", "m")


def fused(spark, sf):
    """All pairs."""
    sem = dense.score_all(with_vector(spark, sf, benchmark_queries(spark, sf), "query_id", 7), with_vector(spark, sf, table(spark, sf, "documents").select("doc_id"), "doc_id", 1))
    return fusion.fuse(doc_scores(spark, sf), sem, table(spark, sf, "documents").agg(F.count("*").alias("n")))


def fused_best(spark, sf, k: int):
    """The k best of each query, found without a row for each pair."""
    docs = shared.stored(with_vector(spark, sf, documents(spark, sf).select("doc_id", text.tokenize(F.col("text")).alias("tokens")), "doc_id", 1), "docs")
    return hybrid.candidates(with_vector(spark, sf, benchmark_queries(spark, sf), "query_id", 7), docs, lexical.build_index(docs), k, store=shared.stored)


@query(f"WITH {BM25_CTES} SELECT query_id, doc_id, round(CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1 ELSE 0 END ELSE (score - lo) / (hi - lo) END, 4) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM scores)")
def min_max_norm(spark, sf):
    return fusion.min_max(doc_scores(spark, sf)).select("query_id", "doc_id", F.round("norm", 4).alias("norm"))


@query(f"WITH {FUSE_CTES} SELECT * FROM fused")
def hybrid_fusion(spark, sf):
    return fused(spark, sf)


@query(f"WITH {FUSE_CTES} SELECT query_id, doc_id, relevance_score, CAST(hybrid_rank AS INT) AS rank, round_even(CASE WHEN top > 1e-9 THEN relevance_score / top * 100 ELSE 0 END::DOUBLE, 0) AS relative_match_score FROM (SELECT *, max(relevance_score) OVER (PARTITION BY query_id) AS top FROM pool) WHERE hybrid_rank <= 10")
def hybrid_topk(spark, sf):
    return fusion.final_top_k(fused_best(spark, sf, 10), 10).select("query_id", "doc_id", "relevance_score", "rank", "relative_match_score")


@query(f"""WITH {FUSE_CTES}, re AS (SELECT query_id, doc_id, relevance_score AS hybrid_score, hybrid_rank, hybrid_rank <= 10 AS reranked, CASE WHEN hybrid_rank <= 10 THEN (doc_id % 17) / 4.1 - 2 END AS raw FROM pool),
fin AS (SELECT *, CASE WHEN reranked THEN round(0.5 / (1 + exp(-raw)) + 0.5 * hybrid_score, 4) ELSE hybrid_score END AS relevance_score FROM re)
SELECT query_id, doc_id, hybrid_score, CASE WHEN reranked THEN round(1 / (1 + exp(-raw)), 4) END AS cross_encoder_norm, reranked, relevance_score, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, reranked DESC, hybrid_rank) AS rank FROM fin) WHERE rank <= 15""")
def rerank_fusion(spark, sf):
    pool = fusion.with_pool(fused_best(spark, sf, 10 + 15), k=15)
    raw = pool.where("in_pool").select("query_id", "doc_id", (F.col("doc_id") % 17 / 4.1 - 2).alias("cross_encoder_raw"))
    return fusion.final_top_k(fusion.rerank(pool, raw), 15).select("query_id", "doc_id", "hybrid_score", "cross_encoder_norm", "reranked", "relevance_score", "rank")


# --- H: versions --------------------------------------------------------------------------------------------------

AMENDED_SQL = """SELECT o_orderkey AS id, concat('IS ', o_orderkey) AS is_number, CASE o_orderstatus WHEN 'F' THEN 'Superseded (DEMO)' ELSE concat('Active ', o_orderstatus) END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END AS revision_year FROM orders"""


def amended(spark, sf):
    """Orders as records, their lines as amendments; some items are bare strings, some years no numbers."""
    lines = table(spark, sf, "lineitem")
    year, n = F.year("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")
    item = F.concat(F.lit('{"amendment_number": '), n, F.lit(', "year": "'), F.when(F.col("l_linenumber") % 4 == 0, "unknown").otherwise(year), F.lit('", "title": "Change '), n, F.lit('"}'))
    items = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_linenumber") % 5 == 0, F.lit('"bare text"')).otherwise(item)).alias("amendments"))
    rows = spark.sql(AMENDED_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders")).join(items, "id", "left")
    return versions.add_versions(rows)


AMENDED_CTE = f"""a AS (SELECT l_orderkey AS id, l_linenumber AS num, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE year(l_shipdate) END AS yr, concat('Change ', l_linenumber) AS title FROM lineitem WHERE l_linenumber % 5 <> 0),
g AS (SELECT id, count(*) AS n, string_agg(concat(num, '/', coalesce(CAST(yr AS VARCHAR), '-'), '/', title), '; ' ORDER BY coalesce(yr, 0) DESC, num DESC) AS history, arg_max(num, coalesce(yr, 0) * 100 + num) AS latest_number, arg_max({{'y': yr}}, coalesce(yr, 0) * 100 + num).y AS latest_year, string_agg(lower(concat(title, ' ', num, ' ', yr)), '|') AS words FROM a GROUP BY id),
v AS (SELECT o.*, coalesce(n, 0) AS amendment_count, coalesce(n, 0) > 0 AS has_amendments, history, latest_number, latest_year, words,
  CASE WHEN contains(lower(status), 'superseded') THEN 'Superseded' WHEN revision_year IS NOT NULL AND n > 0 THEN 'Active — amendments recorded in corpus' WHEN revision_year IS NOT NULL THEN 'Active — latest known revision in corpus' ELSE 'Revision information unavailable' END AS version_status FROM ({AMENDED_SQL}) o LEFT JOIN g USING (id)),
s AS (SELECT *, CASE version_status WHEN 'Superseded' THEN concat(is_number, ' status is recorded as Superseded in the available corpus. Verification required.')
  WHEN 'Active — amendments recorded in corpus' THEN concat(revision_year, ' revision with ', amendment_count, ' amendment(s) recorded in the available corpus', CASE WHEN coalesce(latest_number, 0) <> 0 OR coalesce(latest_year, 0) <> 0 THEN concat(' (Latest: Amd. #', coalesce(CAST(nullif(latest_number, 0) AS VARCHAR), 'N/A'), ', ', coalesce(CAST(nullif(latest_year, 0) AS VARCHAR), 'N/A'), ')') ELSE '' END, '.')
  WHEN 'Active — latest known revision in corpus' THEN concat(revision_year, ' revision with no active amendments recorded in the available demo corpus.')
  ELSE 'Revision year metadata unavailable in the demo corpus. Authoritative verification required.' END AS version_summary FROM v)"""


@query(f"WITH {AMENDED_CTE} SELECT id, CAST(amendment_count AS BIGINT) AS amendment_count, has_amendments, CAST(latest_number AS INT) AS latest_number, CAST(latest_year AS INT) AS latest_year, version_status, version_summary, coalesce(history, '') AS history FROM s")
def version_status(spark, sf):
    told = F.transform("amendment_history", lambda a: F.concat(a["amendment_number"].cast("string"), F.lit("/"), F.coalesce(a["year"].cast("string"), F.lit("-")), F.lit("/"), a["title"]))
    return amended(spark, sf).select("id", "amendment_count", "has_amendments", "latest_number", "latest_year", "version_status", "version_summary", joined(told).alias("history"))


@query(f"WITH {AMENDED_CTE} SELECT count(*) AS total_standards, count(*) FILTER (has_amendments) AS standards_with_amendments FROM s")
def amendments_overview(spark, sf):
    return versions.overview(amended(spark, sf))


@query(f"WITH {AMENDED_CTE} SELECT id, version_status FROM s WHERE contains(lower(is_number), 'change 6') OR contains(lower(version_summary), 'change 6') OR contains(lower(version_status), 'change 6') OR contains(coalesce(words, ''), 'change 6')")
def amendments_search(spark, sf):
    return versions.search(amended(spark, sf), "Change 6").select("id", "version_status")


# --- I: network ---------------------------------------------------------------------------------------------------

GRAPH_NODE_SQL = "SELECT concat('P-', p_partkey) AS id, concat('IS ', 1000 + p_partkey, ' : ', 1990 + p_size % 30) AS is_number, p_name AS title, concat(p_brand, '/', p_size) AS product_category, p_partkey AS ord FROM part"
#: The part of an order's next line is what a line's part refers to, named in one of several ways.
REFERENCE_SQL = """SELECT concat('P-', l_partkey) AS source, CASE WHEN next % 97 = 0 THEN concat('Standard IS ', 1000 + next, ' : 1995') WHEN next % 11 = 0 THEN concat('ISO ', chr(CAST(65 + next % 26 AS INT))) WHEN next % 3 = 0 THEN concat('P-', next) WHEN next % 3 = 1 THEN concat(' is ', 1000 + next, ' : ', 1990 + size % 30) ELSE concat('IS ', 1000 + next, ' (Part 1) : 2001') END AS ref
FROM (SELECT l_partkey, lead(l_partkey) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) JOIN (SELECT p_partkey, p_size AS size FROM part) ON next = p_partkey"""


def nodes(spark, sf):
    return spark.sql(GRAPH_NODE_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))


def resolved(spark, sf):
    refs = spark.sql(REFERENCE_SQL.replace("FROM lineitem", "FROM {lineitem}").replace("FROM part)", "FROM {part})"), lineitem=table(spark, sf, "lineitem"), part=table(spark, sf, "part"))
    return network.resolve(refs, nodes(spark, sf))


def declared(spark, sf):
    """Stored, since each use would resolve the references again."""
    return shared.stored(network.declared_edges(resolved(spark, sf)), "declared")


def graph(spark, sf):
    r = resolved(spark, sf)
    declared = network.declared_edges(r)
    return declared.unionByName(network.inferred_edges(nodes(spark, sf), declared)), network.unresolved(r)


GRAPH_CTES = f"""node AS ({GRAPH_NODE_SQL}),
base AS (SELECT id, lower(id) AS key, ord * 3 AS place, true AS f FROM node UNION ALL SELECT id, lower(is_number), ord * 3 + 1, true FROM node UNION ALL SELECT id, lower(trim(split_part(split_part(is_number, ':', 1), '-', 1))), ord * 3 + 2, false FROM node),
keys AS (SELECT key, coalesce(arg_max(id, place) FILTER (f), arg_min(id, place)) AS id, min(place) AS key_ord FROM base WHERE key <> '' GROUP BY key),
refs AS (SELECT *, lower(trim(ref)) AS w, lower(trim(split_part(split_part(lower(trim(ref)), ':', 1), '-', 1))) AS b FROM ({REFERENCE_SQL})),
dist AS (SELECT DISTINCT ref, w, b FROM refs),
step1 AS (SELECT ref, b, coalesce(k.id, k2.id) AS target FROM dist LEFT JOIN keys k ON w = k.key LEFT JOIN keys k2 ON b = k2.key),
inside AS (SELECT ref, arg_min(k.id, key_ord) AS id FROM step1 JOIN keys k ON contains(k.key, b) OR contains(b, k.key) WHERE target IS NULL AND regexp_matches(b, '[0-9]') GROUP BY ref),
res AS (SELECT source, ref, coalesce(target, inside.id) AS target FROM refs LEFT JOIN step1 USING (ref) LEFT JOIN inside USING (ref)),
decl AS (SELECT DISTINCT source, target FROM res WHERE target IS NOT NULL AND target <> source),
inf AS (SELECT a.id AS source, b.id AS target FROM node a JOIN node b ON trim(a.product_category) = trim(b.product_category) AND a.ord < b.ord
  WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.source = a.id AND d.target = b.id) AND NOT EXISTS (SELECT 1 FROM decl d WHERE d.source = b.id AND d.target = a.id)),
edges AS (SELECT *, 'RELATED_STANDARD' AS relationship_type, false AS is_inferred FROM decl UNION ALL SELECT *, 'SAME_PRODUCT_CATEGORY', true FROM inf),
both_ways AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges),
centre AS (SELECT id FROM node WHERE ord % 50 = 0),
hop1 AS (SELECT id AS centre, v AS id FROM centre JOIN both_ways ON id = u),
hop2 AS (SELECT centre, v AS id FROM hop1 JOIN both_ways ON id = u)"""


@query(f"WITH {GRAPH_CTES} SELECT source, target FROM decl")
def declared_edges(spark, sf):
    return network.declared_edges(resolved(spark, sf)).select("source", "target")


@query(f"WITH {GRAPH_CTES} SELECT source, ref FROM res WHERE target IS NULL")
def unresolved_refs(spark, sf):
    return network.unresolved(resolved(spark, sf))


@query(f"WITH {GRAPH_CTES} SELECT source, target, relationship_type, is_inferred FROM edges WHERE is_inferred")
def inferred_edges(spark, sf):
    return network.filter_edges(graph(spark, sf)[0], "inferred").select("source", "target", "relationship_type", "is_inferred")


@query(f"WITH {GRAPH_CTES} SELECT (SELECT count(*) FROM node) AS total_nodes, count(*) AS total_edges, count(*) FILTER (NOT is_inferred) AS declared_edge_count, count(*) FILTER (is_inferred) AS inferred_edge_count, (SELECT count(*) FROM res WHERE target IS NULL) AS unresolved_reference_count FROM edges")
def graph_stats(spark, sf):
    r = resolved(spark, sf)
    return network.stats_of(nodes(spark, sf), network.declared_edges(r), network.unresolved(r))


def centres(spark, sf):
    return nodes(spark, sf).where("ord % 50 = 0")


@query(f"WITH {GRAPH_CTES} SELECT centre, id, CAST(min(d) AS INT) AS depth FROM (SELECT id AS centre, id, 0 AS d FROM centre UNION ALL SELECT centre, id, 1 FROM hop1 UNION ALL SELECT centre, id, 2 FROM hop2) GROUP BY ALL")
def khop2(spark, sf):
    return network.neighbourhood_of(centres(spark, sf), nodes(spark, sf), network.declared_edges(resolved(spark, sf)), 2)


@query(f"""WITH RECURSIVE {GRAPH_CTES}, walk AS (SELECT id AS centre, id, 0 AS d FROM centre UNION SELECT centre, v, d + 1 FROM walk JOIN both_ways ON id = u WHERE d < 3)
SELECT centre, id, CAST(min(d) AS INT) AS depth FROM walk GROUP BY ALL""")
def khop3(spark, sf):
    return network.neighbourhood_of(centres(spark, sf), nodes(spark, sf), network.declared_edges(resolved(spark, sf)), 3, most=None)


@query(f"WITH {GRAPH_CTES}, mem AS (SELECT id AS centre, id FROM centre UNION SELECT centre, id FROM hop1) SELECT a.centre, source, target, relationship_type FROM edges JOIN mem a ON a.id = source JOIN mem b ON b.id = target AND b.centre = a.centre")
def induced_edges(spark, sf):
    return network.induced_of(centres(spark, sf), nodes(spark, sf), declared(spark, sf)).select("centre", "source", "target", "relationship_type")


@query(f"WITH {GRAPH_CTES}, n AS (SELECT source AS id, target AS neighbour, relationship_type, 0 AS way FROM edges UNION ALL SELECT target, source, relationship_type, 1 FROM edges) SELECT id, neighbour, arg_min(relationship_type, way) AS relationship_type, CAST(min(way) AS INT) AS way FROM n GROUP BY ALL")
def neighbors(spark, sf):
    return network.neighbours_of(nodes(spark, sf), declared(spark, sf)).select("id", "neighbour", "relationship_type", "way")


@query(f"WITH {GRAPH_CTES}, n AS (SELECT source AS id, target AS o FROM edges UNION ALL SELECT target, source FROM edges) SELECT id, count(*) AS n_edges, string_agg(DISTINCT o, ',' ORDER BY o) AS neighbour_ids FROM n GROUP BY id")
def incident_edges(spark, sf):
    return network.incident_of(nodes(spark, sf), declared(spark, sf)).select("id", "n_edges", F.array_join("neighbour_ids", ",").alias("neighbour_ids"))


# --- J: certification ---------------------------------------------------------------------------------------------

RULE_SQL = """SELECT concat('R-', p_brand) AS rule_id, p_brand AS product_category, CAST(NULL AS VARCHAR) AS sid, 'Scheme B' AS certification_scheme, 'historical scheme' AS indication, concat('note ', p_brand) AS notes, min(p_partkey) AS ord FROM part WHERE length(p_brand) = 8 GROUP BY p_brand
UNION ALL SELECT concat('R-P', p_partkey), NULL, concat(' p-', p_partkey, ' '), CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE 'Scheme A' END, CASE WHEN p_partkey % 40 = 0 THEN 'other' END, concat('note ', p_size), 1000000 + p_partkey FROM part WHERE p_size % 10 = 0"""


def rules(spark, sf):
    rows = spark.sql(RULE_SQL.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    text_cols = ["scheme_status", "applicable_order", "order_date", "effective_date", "superseded_by", "applicability_basis", "source_type", "source_reference", "source_url"]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in text_cols})
    none = F.array().cast("array<string>")
    return rows.withColumns({"standard_ids": F.when(F.col("sid").isNull(), none).otherwise(F.array("sid")), "target_standard_ids": none, "verification_required": F.lit(True)}).drop("sid")


CERT_CTE = f"""rule AS ({RULE_SQL}), rec AS ({CATALOG_DUCK}),
ass AS (SELECT rec.id, rec.product_category AS cat, CASE WHEN a.rule_id IS NOT NULL THEN 'standard_id' WHEN c.rule_id IS NOT NULL THEN 'product_category' ELSE 'unmapped' END AS match_kind, coalesce(a.rule_id, c.rule_id) AS rule_id,
  CASE WHEN a.rule_id IS NOT NULL THEN coalesce(a.certification_scheme, 'Unspecified Scheme') WHEN c.rule_id IS NOT NULL THEN c.certification_scheme ELSE 'No certification mapping available' END AS certification_scheme,
  CASE WHEN a.rule_id IS NOT NULL THEN coalesce(a.indication, 'candidate certification requirement') WHEN c.rule_id IS NOT NULL THEN c.indication ELSE 'no certification mapping available' END AS indication,
  CASE WHEN coalesce(a.rule_id, c.rule_id) IS NULL THEN 'Local prototype certification rules' ELSE 'Local prototype rule dataset' END AS source_reference,
  CASE WHEN coalesce(a.rule_id, c.rule_id) IS NULL THEN 'No certification mapping is available in the current prototype rule dataset.' ELSE 'Prototype rule mapping' END AS applicability_basis
  FROM rec LEFT JOIN rule a ON lower(trim(a.sid)) = lower(rec.id) LEFT JOIN rule c ON lower(c.product_category) = lower(rec.product_category))"""


@query(f"WITH {CERT_CTE} SELECT id, match_kind, rule_id, certification_scheme, indication, source_reference, applicability_basis, cat AS matched_product_category FROM ass")
def cert_assess(spark, sf):
    return certify.assess(records(spark, sf), rules(spark, sf)).select("id", "match_kind", "rule_id", "certification_scheme", "indication", "source_reference", "applicability_basis", "matched_product_category")


@query(f"""WITH {CERT_CTE}, req AS (SELECT l_orderkey AS request_id, list(concat('P-', l_partkey)) AS ids, arg_min(p_brand, l_linenumber * 1000000 + l_partkey) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
hit AS (SELECT DISTINCT request_id, rule_id, indication FROM (SELECT request_id, unnest(ids) AS i FROM req) JOIN rule ON lower(trim(sid)) = lower(i) UNION SELECT request_id, rule_id, indication FROM req JOIN rule ON product_category = brand)
SELECT req.request_id, count(rule_id) AS total_rules_matched, coalesce(bool_or(rule_id IS NOT NULL AND coalesce(indication, 'candidate certification requirement') = 'candidate certification requirement'), false) AS has_candidate_requirements FROM req LEFT JOIN hit USING (request_id) GROUP BY 1""")
def cert_request(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    req = lines.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.collect_list(F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))).alias("standard_ids"), F.min_by("p_brand", F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("product_category"))
    return certify.summarize_requests(req, certify.assess_requests(req, rules(spark, sf)))


@query(f"WITH rule AS ({RULE_SQL}) SELECT rule_id, coalesce(certification_scheme, 'Unspecified Scheme') AS certification_scheme, coalesce(indication, 'candidate certification requirement') AS indication, 'requires_authoritative_verification' AS scheme_status, notes, coalesce(sid, '') AS targets FROM rule")
def cert_rules(spark, sf):
    return certify.rules_overview(rules(spark, sf)).select("rule_id", "certification_scheme", "indication", "scheme_status", "notes", joined("target_standard_ids").alias("targets"))


@query(f"WITH rule AS ({RULE_SQL}) SELECT rule_id FROM rule WHERE certification_scheme = 'Scheme A' AND contains(lower(concat(rule_id, '|', coalesce(sid, ''), '|', notes, '|', 'Scheme A')), 'p1')")
def cert_search(spark, sf):
    r = rules(spark, sf).withColumn("target_standard_ids", F.col("standard_ids"))
    return certify.search_rules(r, " P1 ", "Scheme A").select("rule_id")


@query(f"WITH rule AS ({RULE_SQL}) SELECT lower(trim(sid)) AS key, rule_id, 'standard_id' AS kind FROM rule WHERE sid IS NOT NULL UNION ALL SELECT lower(product_category), rule_id, 'product_category' FROM rule WHERE product_category IS NOT NULL")
def rules_index(spark, sf):
    r = rules(spark, sf)
    return certify.by_id(r).select("key", "rule.rule_id", F.lit("standard_id").alias("kind")).unionByName(certify.by_category(r).select("key", "rule.rule_id", F.lit("product_category").alias("kind")))


# --- P1, G9-G11, K: recommendations with reasons, evidence, explanations ------------------------------------------

RANKED_CTES = f"""cat AS ({CATALOG_DUCK}), req AS ({REQUEST_SQL}),
cd AS (SELECT id, {tokens_sql("concat(is_number, ' ', title, ' ', product_category, ' ', sector, ' ', array_to_string(keywords, ' '), ' ', scope)")} AS t FROM cat),
cpost AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM cd) GROUP BY ALL),
cstats AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM cd),
cidf AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM cpost, cstats GROUP BY term),
cq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM req) GROUP BY ALL),
csc AS (SELECT query_id, p.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / greatest(avgdl, 1)))) AS b FROM cq JOIN cpost p USING (term) JOIN cidf USING (term) JOIN cd ON p.id = cd.id, cstats GROUP BY ALL),
clim AS (SELECT query_id, CASE WHEN count(*) < any_value(n) THEN least(0, min(b)) ELSE min(b) END AS lo, max(b) AS hi FROM csc, cstats GROUP BY query_id),
cf AS (SELECT query_id, id, round(b, 4) AS bm25_raw, round((b - lo) / (hi - lo), 4) AS bm25_norm, round(0.4 * (b - lo) / (hi - lo), 4) AS relevance_score FROM csc JOIN clim USING (query_id)),
ranked AS (SELECT *, round_even((relevance_score / max(relevance_score) OVER (PARTITION BY query_id) * 100)::DOUBLE, 0) AS relative_match_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, id) AS rank FROM cf) WHERE rank <= 5),
{CERT_CTE},
graph AS (SELECT cat.id, cat.product_category FROM cat WHERE false),
ver AS (SELECT id, CASE WHEN status = 'Superseded' THEN 'Superseded' WHEN revision_year IS NOT NULL THEN 'Active — latest known revision in corpus' ELSE 'Revision information unavailable' END AS version_status FROM cat),
full_ AS (SELECT r.*, req.query, cat.* EXCLUDE (id), ver.version_status, ass.match_kind, ass.certification_scheme, ass.indication, ass.source_reference, ass.applicability_basis, {norm_sql('query')} AS qn, list_sort(list_distinct({tokens_sql('query')})) AS qt
  FROM ranked r JOIN req USING (query_id) JOIN cat ON cat.id = r.id JOIN ver ON ver.id = r.id JOIN ass ON ass.id = r.id),
why AS (SELECT *, [k FOR k IN [lower(x) FOR x IN keywords] IF contains(qn, k) OR len([t FOR t IN qt IF contains(k, t)]) > 0] AS mk, [t FOR t IN qt IF list_contains({tokens_sql('product_category')}, t)] AS mc, [t FOR t IN qt IF list_contains({tokens_sql('sector')}, t)] AS ms, [t FOR t IN qt IF list_contains({tokens_sql('scope')}, t)] AS mp FROM full_),
told AS (SELECT *, [x FOR x IN [
  CASE WHEN len(mc) > 0 THEN concat('Product category match: ''', product_category, ''' (matched ''', array_to_string(mc, ', '), ''')') WHEN len(ms) > 0 THEN concat('Engineering sector alignment: ''', sector, '''') END,
  CASE WHEN len(mk) > 0 THEN concat('Matched standard keywords: ', array_to_string(mk[1:3], ', ')) END,
  CASE WHEN len(mp) >= 2 THEN concat('High technical scope overlap on terms: ', array_to_string(mp[1:3], ', ')) END,
  CASE WHEN bm25_norm >= 0.5 THEN 'Strong lexical keyword match density' END,
  CASE WHEN coalesce(revision_year, 0) <> 0 THEN concat('Revision year: ', revision_year, ' (', version_status, ')') END,
  CASE WHEN indication = 'candidate certification requirement' THEN concat('Certification scheme: ', certification_scheme, ' (candidate requirement in prototype rules)') END] IF x IS NOT NULL] AS reasons FROM why)"""


def catalog(spark, sf):
    return pipelines.Catalog.build(records(spark, sf).withColumn("product_category", F.col("product_category")), rules(spark, sf))


def recommended(spark, sf):
    """Recommendations without vectors; records of one brand are many, so this catalog infers no edges and has none declared."""
    return pipelines.recommend(requests(spark, sf), catalog_without_inferred(spark, sf), 5)


def plain_reasons(c: str = "reasons"):
    """Reasons without the figure of a score, whose digits the engines write differently."""
    return F.transform(c, lambda r: F.regexp_replace(r, r" \(BM25 normalized score: .*\)$", ""))


@query(f"WITH {RANKED_CTES} SELECT query_id, CAST(rank AS INT) AS rank, id AS doc_id, bm25_raw, bm25_norm, relevance_score, relative_match_score, version_status, match_kind FROM told")
def recommend(spark, sf):
    return recommended(spark, sf).select("query_id", "rank", "doc_id", "bm25_raw", "bm25_norm", "relevance_score", "relative_match_score", "version_status", "match_kind")


@query(f"WITH {RANKED_CTES} SELECT query_id, CAST(rank AS INT) AS rank, array_to_string(reasons, '; ') AS reasons FROM told")
def match_reasons(spark, sf):
    return recommended(spark, sf).select("query_id", "rank", joined(plain_reasons()).alias("reasons"))


@query(f"""WITH {RANKED_CTES} SELECT query_id, count(*) AS total_standards_evaluated, string_agg(concat(id, ':', array_to_string(mk, ','), ':standards.json (demo corpus)|VersionAmendmentAnalyzer (corpus metadata)|CertificationRuleEngine (', source_reference, ')'), '; ' ORDER BY rank) AS evidence FROM told GROUP BY query_id""")
def evidence_package(spark, sf):
    got = evidence.package(evidence.add_evidence(recommended(spark, sf)), ["rank", "doc_id", "matched_keywords", "provenance_sources"])
    say = F.transform("standards_evidence", lambda e: F.concat(e["doc_id"], F.lit(":"), F.array_join(e["matched_keywords"], ","), F.lit(":"), F.array_join(e["provenance_sources"], "|")))
    return got.select("query_id", "total_standards_evaluated", joined(say).alias("evidence"))


@query(f"""WITH {RANKED_CTES} SELECT query_id, CAST(rank AS INT) AS rank, concat('Recommended for query ''', query, ''' based on product alignment with category ''', product_category, ''' and keyword/scope overlap in the prototype corpus.') AS why_relevant,
  concat_ws('; ', concat('Product Category Match: ''', product_category, ''''), CASE WHEN len(mk) > 0 THEN concat('Matched Keywords: ', array_to_string(mk[1:4], ', ')) END) AS matched_requirements,
  concat('Technical scope covers: ', scope) AS scope_alignment, concat(coalesce(CAST(revision_year AS VARCHAR), 'Recorded'), ' revision (', version_status, '). Authoritative BIS verification required.') AS version_note,
  CASE WHEN indication = 'candidate certification requirement' THEN concat('Candidate certification mapping identified under ''', certification_scheme, ''' (', source_reference, '). Authoritative BIS/QCO verification required.') ELSE concat(applicability_basis, ' Authoritative BIS/QCO verification required.') END AS certification_note FROM told""")
def explanations(spark, sf):
    return pipelines.explained(recommended(spark, sf)).select("query_id", "rank", "why_relevant", joined("matched_requirements").alias("matched_requirements"), "scope_alignment", "version_note", "certification_note")


# --- L: gaps ------------------------------------------------------------------------------------------------------

#: A request's requirements are those of the specification texts written for its part.
GAP_REQ_SQL = f"""SELECT req.query_id, req.query, r.* EXCLUDE (query_id, text), text AS raw_text FROM ({REQUEST_SQL}) req JOIN ({REQUIREMENTS_SQL}) r ON r.query_id = (SELECT max(l_orderkey * 100 + l_linenumber) FROM lineitem WHERE l_partkey = req.query_id)"""


def gap_requests(spark, sf):
    """For each supplier's part the last specification text written for it."""
    last = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.max(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("spec"))
    rows = requests(spark, sf).join(last, F.col("query_id") == F.col("part")).select("query_id", "query", "spec")
    texts = specs(spark, sf).withColumn("spec", F.col("l_orderkey") * 100 + F.col("l_linenumber")).join(rows.select("spec"), "spec", "left_semi").groupBy("spec").agg(F.max("text").alias("text"))
    return extract.extract_requirements(shared.dealt(rows.join(texts, "spec").drop("spec")), "query_id").drop("text")


ITEMS_SQL = """list_concat([{'t': concat('Product Type: ', name), 'c': 'product_type', 'v': lower(name)}],
  [{'t': concat_ws(' ', concat(array_to_string([concat(upper(w[1]), w[2:]) FOR w IN string_split(a.a, '_')], '_'), ': ', a.v), nullif(a.u, '')), 'c': a.a, 'v': lower(trim(concat(a.v, ' ', a.u)))} FOR a IN attributes],
  [{'t': concat('Safety Requirement: ', s), 'c': 'safety', 'v': lower(s)} FOR s IN safety], [{'t': concat('Installation/Environment: ', s), 'c': 'installation', 'v': lower(s)} FOR s IN installation],
  [{'t': concat('Specified Standard: ', s), 'c': 'explicit_standard', 'v': lower(s)} FOR s IN mentions])"""
GAP_CTES = f"""{RANKED_CTES},
gr AS ({GAP_REQ_SQL}), gi AS (SELECT query_id, unnest(items) AS x, generate_subscripts(items, 1) AS k FROM (SELECT query_id, {ITEMS_SQL} AS items FROM gr)),
rows_ AS (SELECT query_id, printf('REQ-%03d', k) AS requirement_id, x.t AS requirement_text, x.c AS category, x.v AS value FROM gi),
tok AS (SELECT *, [t FOR t IN string_split_regex(value, '[\\s,/:()''"]+') IF length(t) >= 2 AND t NOT IN ('product', 'type', 'query', 'specification', 'for', 'with', 'and', 'the', 'in', 'of')] AS vt FROM rows_),
exp AS (SELECT *, list_distinct(list_concat(vt, CASE WHEN list_contains(vt, 'hdpe') THEN ['polyethylene', 'pe', 'hdpe'] ELSE [] END, CASE WHEN list_contains(vt, 'xlpe') THEN ['crosslinked', 'polyethylene', 'xlpe'] ELSE [] END, CASE WHEN list_contains(vt, 'pv') OR list_contains(vt, 'photovoltaic') THEN ['photovoltaic', 'pv', 'solar'] ELSE [] END)) AS et FROM tok),
mat AS (SELECT e.*, rank, is_number, lower(scope) AS sc, lower(title) AS ti, lower(coalesce(description, '')) AS de, lower(product_category) AS pc, [lower(k) FOR k IN keywords] AS kw, lower(array_to_string(reasons, ' ')) AS rs FROM exp e JOIN told USING (query_id)),
lev AS (SELECT *, len([t FOR t IN et IF contains(sc, t) OR contains(ti, t) OR contains(pc, t) OR contains(de, t) OR len([k FOR k IN kw IF contains(k, t)]) > 0]) AS m FROM mat),
lvl AS (SELECT query_id, requirement_id, rank, is_number, CASE WHEN contains(sc, value) OR contains(de, value) OR contains(ti, value) THEN 1
  WHEN (len(vt) > 0 AND m / len(vt) >= 0.75) OR (category = 'product_type' AND len(vt) > 0 AND m / len(vt) >= 0.5) THEN 2
  WHEN len([k FOR k IN kw IF contains(k, value) OR contains(value, k)]) > 0 OR contains(rs, value) OR (len(vt) > 0 AND m / len(vt) >= 0.4) THEN 4 END AS level FROM lev),
best AS (SELECT query_id, requirement_id, min(level) AS best, array_to_string([x FOR x, i IN list(is_number ORDER BY rank) FILTER (level IS NOT NULL) IF list_position(list(is_number ORDER BY rank) FILTER (level IS NOT NULL), x) = i], '; ') AS ids FROM lvl GROUP BY ALL),
cov AS (SELECT r.*, CASE WHEN best <= 3 THEN 'covered' WHEN best = 4 THEN 'partially_covered' WHEN category IN ('safety', 'installation') THEN 'requires_verification' ELSE 'not_evidenced' END AS status, coalesce(ids, '') AS ids FROM rows_ r LEFT JOIN best USING (query_id, requirement_id))"""


@query(f"WITH {GAP_CTES} SELECT * FROM rows_")
def gap_requirements(spark, sf):
    return gaps.requirement_rows(gap_requests(spark, sf))


def gap_parts(spark, sf):
    ranked = recommended(spark, sf).withColumn("reasons", plain_reasons())
    return pipelines.gap_report(gap_requests(spark, sf), ranked)


@query(f"WITH {GAP_CTES} SELECT query_id, requirement_id, status, CAST(CASE status WHEN 'covered' THEN 1 WHEN 'partially_covered' THEN 0.6 WHEN 'requires_verification' THEN 0.4 ELSE 0 END AS DOUBLE) AS coverage_score, ids AS supporting FROM cov")
def gap_coverage(spark, sf):
    return gap_parts(spark, sf)[0].select("query_id", "requirement_id", "status", "coverage_score", joined("supporting_standard_ids").alias("supporting"))


@query(f"""WITH {GAP_CTES} SELECT query_id, count(*) AS total_requirements, count(*) FILTER (status = 'covered') AS covered_count, count(*) FILTER (status = 'partially_covered') AS partially_covered_count, count(*) FILTER (status = 'requires_verification') AS requires_verification_count, count(*) FILTER (status = 'not_evidenced') AS not_evidenced_count,
  concat(count(*) FILTER (status = 'covered'), ' of ', count(*), ' extracted procurement requirements have direct supporting evidence in the current prototype corpus. ', count(*) FILTER (status = 'partially_covered'), ' requirement(s) are partially supported, and ', count(*) FILTER (status = 'not_evidenced'), ' requirement(s) were not evidenced in the prototype corpus.') AS coverage_summary FROM cov GROUP BY query_id""")
def gap_summary(spark, sf):
    return gap_parts(spark, sf)[1]


@query(f"""WITH {GAP_CTES}, gs AS (SELECT query_id, count(*) AS n, count(*) FILTER (status = 'covered') AS c FROM cov GROUP BY query_id)
SELECT g.query_id, concat('REP-20240101-', upper(sha256(CAST(g.query_id AS VARCHAR))[:6])) AS report_id, raw_text[:500] AS snippet, string_agg(t.id, '; ' ORDER BY rank) AS recommendations, any_value(gs.n) AS total_requirements, any_value(gs.c) AS covered_count, 0::BIGINT AS n_links
FROM gr g JOIN told t USING (query_id) JOIN gs USING (query_id) GROUP BY g.query_id, raw_text""")
def report_row(spark, sf):
    got = pipelines.reports(gap_requests(spark, sf), catalog_without_inferred(spark, sf), 5, day=F.lit("2024-01-01").cast("date"))
    return got.select("query_id", "metadata.report_id", F.col("input_requirement.raw_text_snippet").alias("snippet"), joined(F.transform("recommendations", lambda r: r["doc_id"])).alias("recommendations"), "gap_analysis.total_requirements", "gap_analysis.covered_count", F.size("network_information").cast("long").alias("n_links"))


@query()
def recommend_from_requirements(spark, sf):
    """Queries built from extracted requirements, with the default pair scorer; compared with the parts' results in the tests."""
    return pipelines.recommend_from_requirements(gap_requests(spark, sf).select("query_id", "requirements"), catalog_without_inferred(spark, sf), 3, fusion.overlap_scorer).select("query_id", "rank", "doc_id", "hybrid_score", "cross_encoder_norm", "relevance_score", "reranked")


def catalog_without_inferred(spark, sf):
    return catalog(spark, sf).without_inferred()


# --- M, A: comparison, synchronisation, sources -------------------------------------------------------------------

COPY_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, ' x') ELSE concat(' ', c_name, ' ') END AS c_name, c_nationkey, CASE WHEN c_custkey % 15 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 35 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_custkey + 100000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 = 0"""
FIELDS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def two_corpora(spark, sf):
    c = table(spark, sf, "customer")
    return c, spark.sql(COPY_SQL.replace("FROM customer", "FROM {customer}"), customer=c)


SYNC_CTE = f"""l AS (SELECT * FROM customer), r AS ({COPY_SQL}),
act AS (SELECT coalesce(l.c_custkey, r.c_custkey) AS id, l.c_custkey IS NOT NULL AS inl, r.c_custkey IS NOT NULL AS inr, trim(l.c_name) IS DISTINCT FROM trim(r.c_name) AS d1, l.c_nationkey IS DISTINCT FROM r.c_nationkey AS d2, l.c_acctbal IS DISTINCT FROM r.c_acctbal AS d3, trim(l.c_mktsegment) IS DISTINCT FROM trim(r.c_mktsegment) AS d4,
  l.c_name AS ln, r.c_name AS rn, l.c_acctbal AS lb, r.c_acctbal AS rb, l.c_mktsegment AS lm, r.c_mktsegment AS rm FROM l FULL JOIN r ON l.c_custkey = r.c_custkey)"""


@query(f"WITH {SYNC_CTE} SELECT id, CASE WHEN NOT inr THEN 'missing' WHEN NOT inl THEN 'extra' ELSE 'common' END AS side FROM act")
def diff_ids(spark, sf):
    return sync.id_diff(*two_corpora(spark, sf), key="c_custkey")


@query(f"WITH {SYNC_CTE} SELECT id, 'c_name' AS field, ln AS left_value, rn AS right_value FROM act WHERE inl AND inr AND d1 UNION ALL SELECT id, 'c_acctbal', CAST(round(lb, 2) AS VARCHAR), CAST(round(rb, 2) AS VARCHAR) FROM act WHERE inl AND inr AND d3 UNION ALL SELECT id, 'c_mktsegment', lm, rm FROM act WHERE inl AND inr AND d4")
def diff_fields(spark, sf):
    got = sync.field_diff(*two_corpora(spark, sf), FIELDS, "c_custkey")
    plain = lambda c: F.when(F.col("field") == "c_acctbal", F.round(F.col(c).try_cast("double"), 2).cast("string")).otherwise(F.col(c)).alias(c)
    return got.select("id", "field", plain("left_value"), plain("right_value"))


@query(f"WITH {SYNC_CTE} SELECT count(*) FILTER (inl) AS left_count, count(*) FILTER (inr) AS right_count, count(*) FILTER (NOT inr) AS missing_count, count(*) FILTER (NOT inl) AS extra_count, count(*) FILTER (inl AND inr AND (d1 OR d2 OR d3 OR d4)) AS changed_count, 0::BIGINT AS stale_count, 'OUT_OF_SYNC' AS status FROM act")
def sync_report(spark, sf):
    return sync.comparison(*two_corpora(spark, sf), FIELDS, key="c_custkey")


@query(f"WITH {SYNC_CTE} SELECT l.* FROM l UNION ALL SELECT r.* FROM r WHERE c_custkey >= 100000000")
def upsert_result(spark, sf):
    left, right = two_corpora(spark, sf)
    return sync.upsert(left, right, "c_custkey")


@query(f"WITH {SYNC_CTE} SELECT CASE WHEN inl AND (NOT inr OR d1 OR d2 OR d3 OR d4) THEN ln ELSE rn END AS c_name, id AS c_custkey, CASE WHEN NOT inr THEN 'insert' WHEN inl AND (d1 OR d2 OR d3 OR d4) THEN 'update' ELSE 'keep' END AS action FROM act")
def sync_actions(spark, sf):
    a = sync.actions(*two_corpora(spark, sf), FIELDS, "c_custkey")
    return a.select(F.when(F.col("action").isin("insert", "update"), F.col("l.c_name")).otherwise(F.col("r.c_name")).alias("c_name"), F.col("id").alias("c_custkey"), "action")


@query(f"WITH {SYNC_CTE} SELECT count(*) FILTER (NOT inr) AS inserted, count(*) FILTER (inl AND inr AND (d1 OR d2 OR d3 OR d4)) AS updated, count(*) FILTER (inl AND inr AND NOT (d1 OR d2 OR d3 OR d4)) AS unchanged, count(*) FILTER (NOT inl) AS deleted, count(*) FILTER (inl) AS total FROM act")
def sync_counts(spark, sf):
    return sync.action_counts(sync.actions(*two_corpora(spark, sf), FIELDS, "c_custkey", delete_extra=True))


def stored_texts(spark, sf):
    """Vectors of parts' names, some for an older text, some missing."""
    p = table(spark, sf, "part")
    return p.where("p_partkey % 6 <> 0").select(F.col("p_partkey").cast("string").alias("standard_id"), F.when(F.col("p_partkey") % 4 == 0, "old text").otherwise(F.col("p_name")).alias("content"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.when(F.col("p_partkey") % 10 == 3, "other").otherwise("own").alias("embedding_model"), F.lit(1).alias("embedding_dimension"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 10 = 3 THEN 'missing_embedding' ELSE 'stale_content' END AS reason FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 10 = 3 OR p_partkey % 4 = 0")
def vector_staleness(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    return sync.vector_staleness(p, stored_texts(spark, sf), "own", F.col("p_name"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'failed' WHEN p_partkey % 6 = 0 OR p_partkey % 10 = 3 OR p_partkey % 4 = 0 THEN 'inserted' ELSE 'updated' END AS outcome FROM part""")
def vector_upsert(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    encoded = p.select("id", F.when(F.col("id").cast("long") % 5 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0))).alias("embedding"))
    return sinks.classify_vectors(p, encoded, stored_texts(spark, sf), 1, "own", F.col("p_name")).select("id", "outcome")


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf):
    return sync.duplicates(table(spark, sf, "part"), ["p_name", "p_brand"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def orphans(spark, sf):
    return sync.orphans(table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size > 10"), "l_partkey", "p_partkey").select(*["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def cascade_delete(spark, sf):
    return sync.cascade(table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size > 10"), "l_partkey", "p_partkey").select(*["l_orderkey", "l_linenumber", "l_partkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'missing o_orderpriority' WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN 'o_totalprice out of bounds' WHEN NOT length(o_orderpriority) BETWEEN 1 AND 8 THEN 'o_orderpriority too short or long' END AS reject_reason FROM orders")
def reject_reasons(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")))
    return sync.with_reject_reason(o, ["o_orderkey", "o_orderpriority"], {"o_totalprice": (1000, 400000)}, {"o_orderpriority": (1, 8)}).select("o_orderkey", "reject_reason")


@query("""SELECT CASE WHEN p_partkey % 8 = 0 THEN concat('IS-', p_partkey, '-', p_size, '-', p_brand) ELSE concat('P-', p_partkey) END AS id, CASE p_size % 3 WHEN 0 THEN 'Active (DEMO / SAMPLE DATA)' WHEN 1 THEN 'DEMO only' ELSE 'Draft (DEMO / SAMPLE DATA)' END AS status, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_keywords FROM part""")
def records_normalized(spark, sf):
    p = table(spark, sf, "part")
    raw = p.select(F.when(F.col("p_partkey") % 8 != 0, F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))).alias("id"), F.concat(F.lit("IS "), F.col("p_partkey").cast("string"), F.lit(":"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_brand")).alias("is_number"), F.when(F.col("p_size") % 3 == 1, "DEMO only").when(F.col("p_size") % 3 == 2, "Draft").alias("status"), F.when(F.col("p_size") % 2 == 0, F.array("p_name")).alias("keywords"), F.col("p_partkey").alias("ord"))
    return corpus.normalize_records(raw).select("id", "status", F.size("keywords").cast("long").alias("n_keywords"))


@query("SELECT DISTINCT concat('  ', upper(p_name), ' ') AS wanted, first_value(p_partkey) OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS ord FROM part")
def lookup_designation(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("is_number"), F.col("p_partkey").alias("ord"))
    return corpus.lookup_designations(p, p.select(F.concat(F.lit("  "), F.upper("is_number"), F.lit(" ")).alias("is_number"))).select("wanted", "ord")


@query(f"SELECT id, is_number, title FROM ({CATALOG_DUCK}) WHERE id IN (SELECT concat('P-', l_partkey) FROM lineitem WHERE l_quantity > 49)")
def lookup_ids(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("id"))
    return corpus.lookup_ids(records(spark, sf), wanted).select("id", "is_number", "title")


@query("SELECT (SELECT count(*) FROM documents) AS n_records, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing, false AS usable")
def vectors_check(spark, sf):
    return corpus.vectors_complete(table(spark, sf, "documents"), table(spark, sf, "embeddings"), "doc_id", "vec_id")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unsupported_extension' WHEN page_id % 7 = 0 THEN 'empty_file' WHEN strlen(html) + 5 > 4000 AND page_id % 3 <> 0 THEN 'too_large' WHEN page_id % 3 = 0 AND strlen(html) > 4000 THEN 'too_large' WHEN page_id % 3 = 0 THEN 'not_a_pdf' END AS reject_reason FROM pages""")
def file_gate(spark, sf):
    p = table(spark, sf, "pages")
    body = F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.concat(F.lit("%PDF-"), "html"))
    files = p.select("page_id", F.concat(F.lit("doc"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, ".txt").otherwise(".PDF")).alias("path"), body.cast("binary").alias("content"))
    return files.select("page_id", corpus.reject_reason("path", "content", 4000))


# --- N: metrics ---------------------------------------------------------------------------------------------------

METRIC_CTES = f"""{COS_CTE},
ran AS (SELECT 'dense' AS system, query_id, doc_id, ql, dl, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs WHERE query_id <> doc_id
  UNION ALL SELECT 'half', query_id, doc_id, ql, dl, row_number() OVER (PARTITION BY query_id ORDER BY half DESC, doc_id) FROM cs WHERE query_id <> doc_id),
top AS (SELECT *, CASE WHEN ql = dl THEN 1 + doc_id % 2 ELSE 0 END AS rel FROM ran WHERE rank <= 14),
rels AS (SELECT DISTINCT query_id, doc_id, 1 + doc_id % 2 AS rel FROM cs WHERE ql = dl AND query_id <> doc_id),
ideal AS (SELECT query_id, count(*) AS n_rel, sum((pow(2, rel) - 1) / log2(i + 1)) FILTER (i <= 3) AS i3, sum((pow(2, rel) - 1) / log2(i + 1)) FILTER (i <= 5) AS i5 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS i FROM rels) GROUP BY query_id),
per AS (SELECT system, query_id, any_value(ql) AS label, {', '.join(f'coalesce(count(*) FILTER (rel > 0 AND rank <= {k}) / {k}, 0) AS p_at_{k}, coalesce(count(*) FILTER (rel > 0 AND rank <= {k}) / any_value(n_rel), 0) AS r_at_{k}' for k in (1, 3, 5))},
  coalesce(max(1 / rank) FILTER (rel > 0 AND rank <= 5), 0) AS mrr, {', '.join(f'coalesce(sum((pow(2, rel) - 1) / log2(rank + 1)) FILTER (rel > 0 AND rank <= {k}) / any_value(i{k}), 0) AS ndcg_at_{k}' for k in (3, 5))} FROM top LEFT JOIN ideal USING (query_id) GROUP BY ALL)"""
MEANS_SQL = ", ".join(f"round(avg({m}), 4) AS {m}" for m in evaluate.METRICS)


def systems(spark, sf):
    q, v = vector_queries(spark, sf), vectors(spark, sf)

    def ranked(q, v):
        # A query's own row may be among the best and doesn't count.
        return lexical.top_k(dense.search(q, v, 15).where("query_id <> doc_id"), 14)

    return {"dense": ranked(q, v), "half": ranked(halves(q), halves(v))}


def metric_rows(spark, sf):
    q, v = vector_queries(spark, sf).select("query_id", "label"), vectors(spark, sf).select("doc_id", "label")
    rel = q.join(v, "label").where("query_id <> doc_id").select("query_id", "doc_id", (1 + F.col("doc_id") % 2).alias("rel"))
    return evaluate.per_query(evaluate.compare_systems(systems(spark, sf)), rel, q)


@query(f"WITH {METRIC_CTES} SELECT system, query_id, {', '.join(f'round({m}, 6) AS {m}' for m in evaluate.METRICS[:6])} FROM per")
def precision_recall(spark, sf):
    return metric_rows(spark, sf).select("system", "query_id", *[F.round(m, 6).alias(m) for m in evaluate.METRICS[:6]])


@query(f"WITH {METRIC_CTES} SELECT system, query_id, round(mrr, 6) AS mrr FROM per")
def mrr(spark, sf):
    return metric_rows(spark, sf).select("system", "query_id", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {METRIC_CTES} SELECT system, query_id, round(ndcg_at_3, 6) AS ndcg_at_3, round(ndcg_at_5, 6) AS ndcg_at_5 FROM per")
def ndcg(spark, sf):
    return metric_rows(spark, sf).select("system", "query_id", F.round("ndcg_at_3", 6).alias("ndcg_at_3"), F.round("ndcg_at_5", 6).alias("ndcg_at_5"))


@query(f"WITH {METRIC_CTES} SELECT system, count(*) AS n_queries, {MEANS_SQL} FROM per GROUP BY system")
def metrics_by_system(spark, sf):
    return evaluate.by_system(metric_rows(spark, sf))


@query(f"WITH {METRIC_CTES} SELECT system, coalesce(CAST(label AS VARCHAR), 'ALL') AS label, count(*) AS n_queries, {MEANS_SQL} FROM per GROUP BY GROUPING SETS ((system), (system, label))")
def metrics_by_group(spark, sf):
    return evaluate.by_group(metric_rows(spark, sf), "label")


@query(f"WITH {METRIC_CTES}, m AS (SELECT system, {MEANS_SQL} FROM per GROUP BY system), u AS (UNPIVOT m ON {', '.join(evaluate.METRICS)} INTO NAME metric VALUE value) SELECT metric, max(value) FILTER (system = 'half') AS baseline, max(value) FILTER (system = 'dense') AS candidate, round(max(value) FILTER (system = 'dense') - max(value) FILTER (system = 'half'), 4) AS change FROM u GROUP BY metric")
def metric_delta(spark, sf):
    return evaluate.delta(evaluate.by_system(metric_rows(spark, sf)), "half", "dense")


@query(f"""WITH {METRIC_CTES}, s AS (SELECT query_id, list(DISTINCT doc_id) FILTER (system = 'dense') AS a, list(DISTINCT doc_id) FILTER (system = 'half') AS b, max(doc_id) FILTER (system = 'dense' AND rank = 1) = max(doc_id) FILTER (system = 'half' AND rank = 1) AS same FROM top WHERE rank <= 5 GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN same THEN 100 ELSE 0 END), 2) AS top1_agreement, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 100), 2) AS mean_jaccard FROM s""")
def backend_agreement(spark, sf):
    s = systems(spark, sf)
    return evaluate.agreement(s["dense"], s["half"])


@query(f"WITH {COS_CTE} SELECT DISTINCT query_id, doc_id, CAST(1 + doc_id % 2 AS INT) AS rel FROM cs WHERE ql = dl AND query_id <> doc_id")
def relevance_judgements(spark, sf):
    q, v = vector_queries(spark, sf).select("query_id", "label"), vectors(spark, sf).select("doc_id", "label")
    gold = q.join(v, "label").where("query_id <> doc_id").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", (1 + F.col("doc_id") % 2).cast("int")))).alias("relevance"))
    return evaluate.judgements(gold, "query_id")


# --- P6: streams --------------------------------------------------------------------------------------------------


@query(rf"""SELECT doc_id, CAST(length({norm_sql('text')}) AS INT) AS n_normal, CAST(len({tokens_sql('text')}) AS INT) AS n_tokens, {NAME_SQL} AS name, {CATEGORY_SQL} AS category, CAST(len([x FOR x, i IN every IF list_position([y.s FOR y IN every], x.s) = i]) AS INT) AS n_attributes, CAST(len([m FOR m, i IN ms IF list_position([upper(x) FOR x IN ms], upper(m)) = i]) AS INT) AS n_mentions
FROM (SELECT *, {ATTRIBUTES_SQL} AS every, [regexp_replace(trim(m), '\s+', ' ', 'g') FOR m IN regexp_extract_all(text, '{extract.MENTION}')] AS ms FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def stream_enrich(spark, sf):
    """The documents as a stream, to the end; what it appended is read back."""
    out = shared.new_path(spark, "stream")
    docs = table(spark, sf, "documents")
    source = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parque[t]")  # a pattern: the table may be one file
    got = enrich.enrich_documents(source)
    got.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{out}/rows").select("doc_id", "n_normal", "n_tokens", "product.name", "product.category", F.size("technical_requirements").alias("n_attributes"), F.size("standards_mentions").alias("n_mentions"))
