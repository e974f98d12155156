"""The operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmatch.llm import capfilter, cascade, chat, decontaminate, divergence, lm_brown, omh, packing, pii, quality, spelling, toxicity, warc
from procmatch.llm.common import id_remainder, read_table

#: The key of the registered query; users bring their own.
KEY = "procmatch-demo-key"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group_bins", "group_bound")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, count_col="n_found")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(read_table(spark, sf_dir, "documents"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 7) == 2, F.lit(False))
    model, counts = lm_brown.train(docs.where(~held_out).select("text"))
    scored = lm_brown.score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"), slip=spelling.SLIP)


def op12_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(read_table(spark, sf_dir, "documents")).drop("rejected_by", "n_rules")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_benchmark_decontamination, op3_pii_surrogates, op4_warc, op5_quality_neighbours, op6_order_minhash, op7_brown_lm, op8_toxicity, op9_cap_filters, op10_chat_snapshots,
        op11_spelling_variants, op12_quality_cascade, op13_source_divergence,
    )
}

def _crc_table() -> list[int]:
    """Of crc32, for half a byte at a time."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: crc32 of a string's UTF-8 bytes, low halves first.
_CRC = f"xor(4294967295, list_reduce([strpos('0123456789ABCDEF', hex(s)[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 FOR i IN range(2 * strlen(s))], lambda c, x: xor(({_crc_table()})[CAST(xor(c, x) & 15 AS INT) + 1], c >> 4), CAST(4294967295 AS BIGINT)))"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HAS_WORD = r"'[^\x20\x09-\x0D]'"

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_benchmark_decontamination": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT item_id, unnest([array_to_string(w[k:k + 9], ' ') FOR k IN range(1, len(w) - 8)]) AS g, 10 AS n FROM i WHERE len(w) >= 10
  UNION ALL SELECT item_id, array_to_string(w, ' '), len(w) FROM i WHERE len(w) BETWEEN 1 AND 9),
lengths AS (SELECT DISTINCT n FROM win),
starts AS (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n),
grams AS (SELECT row, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM starts),
hit AS (SELECT row, grams.n, k, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
places AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM hit) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (row) LEFT JOIN items USING (row)""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  """ + " || ".join(f"translate(lpad(to_base(CAST('0x' || h[{5 * k + 1}:{5 * k + 5}] AS BIGINT), 32), 4, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for k in range(8)) + """ AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM s""",
    "op10_chat_snapshots": """
WITH c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS t FROM conversations GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, t, count(*) AS n_copies FROM c GROUP BY t),
longer AS (SELECT DISTINCT list_slice(t, 1, k) AS t FROM (SELECT t, unnest(range(1, len(t))) AS k FROM one))
SELECT conv_id, CAST(len(t) AS BIGINT) AS n_turns, n_copies, array_to_string([concat('<|im_start|>', x.role, chr(10), x.text, '<|im_end|>') FOR x IN t], chr(10)) AS chat
FROM one ANTI JOIN longer USING (t)""",
    "op11_spelling_variants": f"""
WITH RECURSIVE runs AS (SELECT s, run, count(*) AS k FROM (SELECT concat(CAST(doc_id AS VARCHAR), ':', run) AS s, run FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-zÀ-ÿ]{{6,}}')) AS run FROM documents)) GROUP BY ALL),
hashed AS (SELECT run, k, {_CRC} AS h FROM runs),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
vocab AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
dels AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS near, b.n FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM dels a JOIN vocab b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM dels a JOIN vocab b ON a.d = b.word),
best AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * v.n THEN near END AS form, CASE WHEN b.n >= 5 * v.n THEN b.n END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
steps AS (SELECT word, form AS goal, 1 AS step FROM formed WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN formed f ON f.word = s.goal WHERE f.form IS NOT NULL),
led AS (SELECT word, arg_max(goal, step) AS root FROM steps GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN led USING (word)""",
    "op12_quality_cascade": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, {_HAS_WORD})] AS ls FROM documents),
win AS (SELECT row, k, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
twice AS (SELECT row, k FROM win QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
rep AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY row),
pair AS (SELECT row, max(m * chars) AS top FROM (SELECT row, any_value(length(a) + length(b)) AS chars, count(*) AS m, max(count(*)) OVER (PARTITION BY row) AS most FROM (SELECT row, w[k] AS a, w[k + 1] AS b FROM (SELECT row, w, unnest(range(1, len(w))) AS k FROM d)) GROUP BY row, a, b) WHERE m = most AND m > 1 GROUP BY row),
m AS (SELECT doc_id, t, w, ls, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(top, 0) AS top FROM d LEFT JOIN rep USING (row) LEFT JOIN pair USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
  OR 5 * len([x FOR x IN w IF regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')]) < 4 * n_words OR 10 * len([x FOR x IN w IF len(regexp_extract_all(x, '[A-ZÀ-ÖØ-Þ]')) > 1 AND NOT regexp_matches(x, '[a-zß-öø-ÿ]')]) > 3 * n_words
  OR 10 * (length(t) - length(replace(t, '!', ''))) > n_words OR 2 * n_dup_lines > len(ls) OR 10 * len([x FOR x IN ls IF regexp_matches(x, '^[ \t]*[-*•]')]) > 9 * len(ls) OR 10 * len([x FOR x IN ls IF regexp_matches(x, '(\.\.\.|…)[ \t\r]*$')]) > 3 * len(ls)
  OR 5 * top > word_chars OR 10 * len(list_distinct(w)) < n_words) AS kept FROM b""",
    "op13_source_divergence": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tf AS MATERIALIZED (SELECT row, lang, source, term, count(*) AS k FROM (SELECT row, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(k) AS HUGEINT) AS n FROM tf GROUP BY ALL HAVING count(*) >= 3),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, CAST(sum(k) AS HUGEINT) AS n FROM tf JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (total + v) AS HUGEINT) AS p FROM grp JOIN langs l(lang, v, _t) USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS HUGEINT) AS q FROM kept JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 200""",
}
