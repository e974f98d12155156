"""Chat formatting of logged conversations, after snapshots that longer logs continue have been dropped.

Every turn has a hash of its role and text, and every prefix of a conversation a hash that rolls on from turn to turn: the exclusive or of the SHA-256
digests of (place, role, text) of its turns. A conversation whose own hash is a proper prefix of another one goes, by an anti-join on hashes; of equal
conversations the one with the smallest id stays. Only hashes take part in this; texts move once, for those that stay.

Turns are sorted by range over all tasks, so a conversation of very many turns is cut into runs in several tasks: each run is numbered and rolled by itself, and
a table with one row for each run brings the turns and the hash before it.

Turns are ordered by turn, role and the text's hash (nulls first); a null text or role counts as empty; repeated rows are repeated
turns; rows with a null conv_id are one conversation; texts of any length count whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmatch.llm.common import free_name, stored

START, END = "<|im_start|>", "<|im_end|>"
#: Four numbers of 64 bits are a hash.
HASH = ["h0", "h1", "h2", "h3"]


def _turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, at, text)``; ``at`` orders the turns and identifies what they say."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.sha2(text.cast("binary"), 256).alias("says"))
    return turns.select("conv_id", at.alias("at"), text.alias("text"))


def _quarter(digest: Column, k: int) -> Column:
    """64 of a digest's bits as a long."""
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(16 * k + 1), 32).bitwiseOR(half(16 * k + 9))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, n_turns, h0, h1, h2, h3)``: the hash of the first ``place`` turns."""
    rows = _turns(turns).select("conv_id", "at").repartitionByRange("conv_id", "at")
    rows = stored(rows.withColumn("run", F.spark_partition_id()), "turns")
    runs = rows.groupBy("conv_id", "run").agg(F.count("*").alias("k"))
    w = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    runs = runs.select("conv_id", "run", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"), F.sum("k").over(every).alias("n_turns"))
    own = Window.partitionBy("conv_id", "run").orderBy("at")
    placed = rows.withColumn("own", F.row_number().over(own)).join(runs.withColumnsRenamed({"conv_id": "c", "run": "r"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    place = F.col("before") + F.col("own")
    digest = F.sha2(F.concat_ws("|", place.cast("string"), F.sha2(F.col("at.role").cast("binary"), 256), "at.says").cast("binary"), 256)
    placed = placed.select("conv_id", "run", place.alias("place"), "n_turns", digest.alias("digest")).select("conv_id", "run", "place", "n_turns", *[_quarter(F.col("digest"), k).alias(h) for k, h in enumerate(HASH)])
    placed = stored(placed, "placed")
    # What the runs before each run come to, of conversations with more than one.
    sums = placed.groupBy("conv_id", "run").agg(*[F.bit_xor(h).alias(h) for h in HASH])
    sums = sums.select("conv_id", "run", *[F.coalesce(F.bit_xor(h).over(w), F.lit(0).cast("long")).alias(f"{h}_before") for h in HASH])
    inside = Window.partitionBy("conv_id", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "run", "place", "n_turns", *[F.bit_xor(h).over(inside).alias(h) for h in HASH])
    sums = sums.withColumnsRenamed({"conv_id": "c", "run": "r"})
    both = rolled.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    return both.select("conv_id", "place", "n_turns", *[F.col(h).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in HASH])


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the conversations that no longer one continues; ``n_copies`` counts equal ones, itself included."""
    hashes = stored(prefix_hashes(turns), "prefixes")
    whole = hashes.where("place = n_turns").groupBy(*HASH, "n_turns").agg(F.min("conv_id").alias("low"), F.count("*").alias("n_copies"))
    proper = hashes.where("place < n_turns").select(*HASH, F.col("place").alias("n_turns")).distinct()
    # min leaves nulls out, so a named conversation stands for an equal one without an id.
    return whole.join(proper, [*HASH, "n_turns"], "left_anti").select(F.col("low").alias("conv_id"), "n_turns", "n_copies")


def render(turns: DataFrame, start: str = START, end: str = END, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(conv_id, keys, chat)``, each turn as start mark, role, line break, text, end mark; ``keys``: columns that have one value in a conversation.

    A conversation's chat is one value, so its turns meet in one task here and only here.
    """
    rows = _turns(turns)
    if not keys:
        return _rendered(rows, start, end)
    own = [free_name(f"key_{i}", rows.columns) for i in range(len(keys))]
    values = turns.select(F.col("conv_id").alias("of"), *[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)]).distinct()
    joined = rows.join(values, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    return _rendered(joined, start, end, tuple(own)).toDF("conv_id", *keys, "chat")


def _rendered(rows: DataFrame, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    turn = lambda x: F.concat(F.lit(start), x["at"]["role"], F.lit("\n"), x["text"], F.lit(end))
    got = rows.groupBy("conv_id").agg(F.collect_list(F.struct("at", "text")).alias("turns"), *[F.first(k).alias(k) for k in keys])
    return got.select("conv_id", *keys, F.array_join(F.transform(F.array_sort("turns"), turn), "\n").alias("chat"))


def format_chats(turns: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, n_turns, n_copies, chat``.

    Texts are shuffled once: what joins them to the kept ids also groups them.
    """
    kept, rows = maximal(turns).withColumnRenamed("conv_id", "kept"), _turns(turns)
    return _rendered(rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).drop("kept"), start, end, ("n_turns", "n_copies"))
