"""Two versions of a table: what differs, and bringing one to the other's state; checks of keys and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.functions.text import blank, embedding_content, normalize_value
from procmatch.schemas import REQUIRED


def id_diff(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """``(id, side)`` of each id: missing (left only), extra (right only), common; from one full join."""
    a, b = (x.select(F.col(key).alias("id"), F.lit(True).alias(n)).where("id is not null").distinct() for x, n in ((left, "_l"), (right, "_r")))
    return a.join(b, "id", "full_outer").select("id", F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").otherwise("common").alias("side"))


def _same(df: DataFrame, other: DataFrame, field: str) -> Column:
    kind = df.schema[field].dataType.simpleString()
    return normalize_value(F.col(f"l.{field}"), kind).eqNullSafe(normalize_value(F.col(f"r.{field}"), kind))


def field_diff(left: DataFrame, right: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``(id, field, left_value, right_value)`` of common ids' fields that differ, after trimming; nulls are equal."""
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    text = lambda side, f: (F.to_json(F.col(f"{side}.{f}")) if "array" in left.schema[f].dataType.simpleString() else F.col(f"{side}.{f}").cast("string"))
    items = [F.when(~_same(left, right, f), F.struct(F.lit(f).alias("field"), text("l", f).alias("left_value"), text("r", f).alias("right_value"))) for f in fields if f in left.columns and f in right.columns]
    return both.select(F.col(f"l.{key}").alias("id"), F.explode(F.array_compact(F.array(*items))).alias("x")).select("id", "x.*")


def actions(source: DataFrame, target: DataFrame, fields: list[str], key: str = "id", delete_extra: bool = False) -> DataFrame:
    """``target`` joined to ``source`` by one full join: ``(id, action)`` and both rows as ``l`` and ``r``; insert, update, keep or delete."""
    both = source.alias("l").join(target.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    changed = ~F.lit(True)
    for f in fields:
        changed = changed | ~_same(source, target, f)
    action = F.when(F.col(f"r.{key}").isNull(), "insert").when(F.col(f"l.{key}").isNull(), "delete" if delete_extra else "keep").when(changed, "update").otherwise("keep")
    row = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in source.columns])
    return both.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias("id"), action.alias("action"), F.col(f"l.{key}").isNotNull().alias("in_source"), F.col(f"r.{key}").isNotNull().alias("in_target"), row("l").alias("l"), row("r").alias("r"))


def synchronized(acts: DataFrame) -> DataFrame:
    """The target's new rows: source rows inserted or updated, others kept. Write it once, then put it in the target's place."""
    return acts.where("action <> 'delete'").select(F.when(F.col("action").isin("insert", "update"), F.col("l")).otherwise(F.col("r")).alias("x")).select("x.*")


def action_counts(acts: DataFrame) -> DataFrame:
    """One row."""
    return acts.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"), ("keep", "unchanged"), ("delete", "deleted"))], F.count_if(F.col("action") != "delete").alias("total"))


def upsert(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the target under the source's: new ones added, others replaced; of source rows with one key one counts."""
    new = source.dropDuplicates([key])
    return new.unionByName(target.join(new.select(key), key, "left_anti").select(new.columns))


def vector_staleness(records: DataFrame, vectors: DataFrame, model: str, content: Column | None = None, key: str = "id") -> DataFrame:
    """``(id, reason)``: records without a vector of the model, or whose vector is of another text; records without text don't count."""
    own = records.select(F.col(key).alias("id"), (embedding_content() if content is None else content).alias("_text")).where("_text <> ''")
    have = vectors.where(F.col("embedding_model") == model).groupBy(F.col("standard_id").alias("id")).agg(F.collect_set("content").alias("_have"))
    reason = F.when(F.col("_have").isNull(), "missing_embedding").when(~F.array_contains("_have", F.col("_text")), "stale_content")
    return own.join(have, "id", "left").select("id", reason.alias("reason")).where("reason is not null")


def comparison(left: DataFrame, right: DataFrame, fields: list[str], stale: DataFrame | None = None, key: str = "id") -> DataFrame:
    """One row of counts and the status EMPTY_POSTGRES, IN_SYNC or OUT_OF_SYNC."""
    acts = actions(left, right, fields, key, delete_extra=True)
    counts = acts.agg(F.count_if("in_source").alias("left_count"), F.count_if("in_target").alias("right_count"), F.count_if(F.col("action") == "insert").alias("missing_count"), F.count_if(F.col("action") == "delete").alias("extra_count"), F.count_if(F.col("action") == "update").alias("changed_count"))
    n = stale.agg(F.count("*").alias("stale_count")) if stale is not None else None
    out = counts.join(F.broadcast(n)) if n is not None else counts.withColumn("stale_count", F.lit(0).cast("long"))
    same = (F.col("missing_count") + F.col("extra_count") + F.col("changed_count") + F.col("stale_count")) == 0
    return out.withColumn("status", F.when(F.col("right_count") == 0, "EMPTY_POSTGRES").when(same, "IN_SYNC").otherwise("OUT_OF_SYNC"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str = "standard_id", key: str = "id") -> DataFrame:
    return children.join(parents.select(F.col(key).alias(child_key)), child_key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, child_key: str = "standard_id", key: str = "id") -> DataFrame:
    """Children whose parents remain."""
    return children.join(parents.select(F.col(key).alias(child_key)), child_key, "left_semi")


def with_reject_reason(df: DataFrame, required: list[str] | None = None, bounds: dict[str, tuple[float, float]] | None = None, lengths: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``reject_reason``: the first required field that is missing, value out of bounds or text of a wrong length; null if none."""
    checks = [F.when(blank(F.col(c).cast("string")) == "", F.lit(f"missing {c}")) for c in (REQUIRED if required is None else required)]
    checks += [F.when(~F.col(c).between(a, b), F.lit(f"{c} out of bounds")) for c, (a, b) in (bounds or {}).items()]
    checks += [F.when(~F.length(c).between(a, b), F.lit(f"{c} too short or long")) for c, (a, b) in (lengths or {}).items()]
    return df.withColumn("reject_reason", F.coalesce(*checks, F.lit(None).cast("string")))
