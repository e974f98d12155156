"""The request loop as streams: documents and queries arrive, results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmatch.functions.extract import installation_clauses, is_mentions, product, safety_clauses, technical_attributes
from procmatch.functions.text import normalize_text, tokenize
from procmatch.plans import pipelines


def enrich_documents(stream: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Requirements of each document, row by row; no state, so output is appended at once. Keywords need counts and are left to ``on_batches``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return stream.select(doc, F.length(normalize_text(t)).alias("n_normal"), F.size(tokenize(t)).alias("n_tokens"), product(t).alias("product"), technical_attributes(t).alias("technical_requirements"), is_mentions(t).alias("standards_mentions"), safety_clauses(t).alias("safety_requirements"), installation_clauses(t).alias("installation_requirements"))


def join_records(stream: DataFrame, records: DataFrame, on: str) -> DataFrame:
    """Each arriving row with its record: a stream and a table, joined without state."""
    return stream.join(records, on, "left")


def on_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Ranks whole batches of requests, which a stream alone can't, and writes each batch once: its folder is named by its number, so a batch that runs again overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def arriving(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Requests as Parquet files that arrive in a folder, at most ``files`` of them in a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def recommend_stream(stream: DataFrame, catalog: pipelines.Catalog, path: str, checkpoint: str, k: int = 5, scorer=None, columns: Callable[[DataFrame], DataFrame] | None = None):
    """A writer that recommends records for each batch of requests ``(query_id, query[, embedding])``.

    A stream that is stopped or dies goes on from its checkpoint: a batch that wasn't finished runs again into the same folder, one that was doesn't.
    """
    return on_batches(stream, lambda batch: (columns or (lambda df: df))(pipelines.recommend(batch, catalog, k, scorer)), path, checkpoint)


def ranked_so_far(spark: SparkSession, path: str) -> DataFrame:
    """What all batches have written."""
    return spark.read.parquet(path).drop("batch")
