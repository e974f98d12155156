"""Certification rules: looked up by id, else by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmatch.functions.text import blank
from procmatch.operators.fusion import CANDIDATE

# What stands where a rule is silent, and for records without a rule.
DEFAULTS = {
    "certification_scheme": "Unspecified Scheme", "scheme_status": "requires_authoritative_verification", "indication": CANDIDATE, "applicability_basis": "Prototype rule mapping",
    "source_type": "prototype_rule_dataset", "source_reference": "Local prototype rule dataset", "notes": "Authoritative BIS verification required.",
}
UNMAPPED = {
    "certification_scheme": "No certification mapping available", "scheme_status": "unmapped", "indication": "no certification mapping available",
    "applicability_basis": "No certification mapping is available in the current prototype rule dataset.", "source_type": "prototype_rule_dataset", "source_reference": "Local prototype certification rules",
    "notes": "Certification applicability requires authoritative verification against official BIS / Ministry notifications.",
}
PLAIN = ["applicable_order", "order_date", "effective_date", "superseded_by", "source_url"]


def key(c: Column) -> Column:
    return F.lower(F.trim(c))


def by_id(rules: DataFrame) -> DataFrame:
    """``(key, rule)``: of rules for the same id the last."""
    rows = rules.where("rule_id is not null").select(F.explode("standard_ids").alias("k"), F.struct(*rules.columns).alias("rule"), "ord")
    return rows.where("k is not null and k <> ''").groupBy(key(F.col("k")).alias("key")).agg(F.max_by("rule", "ord").alias("rule"))


def by_category(rules: DataFrame) -> DataFrame:
    rows = rules.where("rule_id is not null and product_category is not null and product_category <> ''").select(key(F.col("product_category")).alias("key"), F.struct(*rules.columns).alias("rule"), "ord")
    return rows.groupBy("key").agg(F.max_by("rule", "ord").alias("rule"))


def assessment(rule: Column, matched_id: Column, matched_category: Column) -> list[Column]:
    """A rule's fields with what stands for missing ones; of a null rule the fields of an unmapped record."""
    mapped = rule.isNotNull()
    said = [F.when(mapped, F.coalesce(F.nullif(rule[c], F.lit("")), F.lit(v))).otherwise(UNMAPPED[c]).alias(c) for c, v in DEFAULTS.items()]
    targets = F.coalesce(F.when(F.size(rule["target_standard_ids"]) > 0, rule["target_standard_ids"]), rule["standard_ids"], F.array().cast("array<string>"))
    return [
        rule["rule_id"].alias("rule_id"), targets.alias("target_standard_ids"), *said, *[rule[c].alias(c) for c in PLAIN], matched_id.alias("matched_standard_id"),
        F.coalesce(matched_category, rule["product_category"]).alias("matched_product_category"), F.coalesce(rule["verification_required"], F.lit(True)).alias("verification_required"),
    ]


def assess(records: DataFrame, rules: DataFrame, id_col: str = "id", category: str = "product_category") -> DataFrame:
    """``(id, match_kind, assessment fields)`` for each record; a blank id gives way to the designation."""
    own = F.trim(F.coalesce(F.nullif(blank(F.col(id_col)), F.lit("")), blank(F.col("is_number")) if "is_number" in records.columns else F.lit("")))
    cat = F.trim(blank(F.col(category)))
    rows = records.select(F.col(id_col).alias("_rec"), own.alias("_own"), cat.alias("_cat"))
    i, c = by_id(rules).select(F.col("key").alias("_ki"), F.col("rule").alias("_ri")), by_category(rules).select(F.col("key").alias("_kc"), F.col("rule").alias("_rc"))
    both = rows.join(i, F.lower("_own") == F.col("_ki"), "left").join(c, F.lower("_cat") == F.col("_kc"), "left")
    kind = F.when(F.col("_ri").isNotNull(), "standard_id").when(F.col("_rc").isNotNull(), "product_category").otherwise("unmapped")
    return both.select(F.col("_rec").alias(id_col), kind.alias("match_kind"), *assessment(F.coalesce("_ri", "_rc"), F.nullif("_own", F.lit("")), F.nullif("_cat", F.lit(""))))


def assess_requests(requests: DataFrame, rules: DataFrame, request: str = "request_id", ids: str = "standard_ids", category: str = "product_category") -> DataFrame:
    """A row for each rule that a request matches ``(request_id, rule_id, match_kind, matched_standard_id, position, indication, certification_scheme)``: by its ids first, in their order, then by category."""
    i = by_id(rules)
    named = requests.select(F.col(request).alias("request_id"), F.posexplode(ids).alias("position", "sid")).where("sid is not null and sid <> ''")
    hits = named.join(i, key(F.col("sid")) == i["key"]).select("request_id", F.lit("standard_id").alias("match_kind"), F.col("sid").alias("matched_standard_id"), "position", "rule")
    c = by_category(rules)
    cats = requests.select(F.col(request).alias("request_id"), F.col(category).alias("cat")).where(F.trim(F.coalesce("cat", F.lit(""))) != "")
    more = cats.join(c, key(F.col("cat")) == c["key"]).select("request_id", F.lit("product_category").alias("match_kind"), F.lit(None).cast("string").alias("matched_standard_id"), F.lit(2**31 - 1).alias("position"), "rule")
    w = Window.partitionBy("request_id", "rule.rule_id").orderBy("position")
    first = hits.unionByName(more).withColumn("n", F.row_number().over(w)).where("n = 1")
    value = lambda f: F.coalesce(F.nullif(F.col(f"rule.{f}"), F.lit("")), F.lit(DEFAULTS[f]))
    return first.select("request_id", F.col("rule.rule_id").alias("rule_id"), "match_kind", "matched_standard_id", "position", value("indication").alias("indication"), value("certification_scheme").alias("certification_scheme"))


def summarize_requests(requests: DataFrame, matched: DataFrame, request: str = "request_id") -> DataFrame:
    """``(request_id, total_rules_matched, has_candidate_requirements)`` of all requests."""
    got = matched.groupBy("request_id").agg(F.count("*").alias("n"), F.bool_or(F.col("indication") == CANDIDATE).alias("c"))
    return requests.select(F.col(request).alias("request_id")).distinct().join(got, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).cast("long").alias("total_rules_matched"), F.coalesce("c", F.lit(False)).alias("has_candidate_requirements"))


def rules_overview(rules: DataFrame) -> DataFrame:
    return rules.where("rule_id is not null").select("ord", *assessment(F.struct(*rules.columns), F.lit(None).cast("string"), F.lit(None).cast("string")))


def search_rules(rules: DataFrame, text: str = "", scheme: str = "ALL") -> DataFrame:
    """Rules that hold the text in their id, category, scheme, targets or notes; of one scheme, or of all."""
    q = F.lit(text.lower().strip())
    holds = lambda c: F.contains(F.lower(blank(c)), q)
    targets = F.coalesce("target_standard_ids", "standard_ids", F.array().cast("array<string>"))
    found = rules.where(holds(F.col("rule_id")) | holds(F.col("product_category")) | holds(F.col("certification_scheme")) | holds(F.col("notes")) | F.exists(targets, holds))
    return found if scheme == "ALL" else found.where(F.col("certification_scheme") == scheme)
