"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers of ``K`` words carry the number of their occurrence, so that repeats differ. For each of ``SKETCHES`` hash functions the ``PER_SKETCH``
k-mers with the smallest hashes, in the order of the text, make one sketch: equal sketches need shared k-mers in the
same order, which edit similarity makes likely. Documents with a sketch in common are candidates; a pair links if the word edit distance,
computed in a band as wide as allowed (``align``), is at most 1 - ``SIMILARITY`` of the longer document's words.

Equal documents (the same words, lower case) collapse first. A bucket's documents are then compared in three steps:

1. each with the bucket's smallest id;
2. where classes are left apart, each with a document drawn by hash, another one in each bucket;
3. where classes are still apart, all pairs of different classes, in blocks inside tasks: by lengths and by the word pairs that
   they share, which leaves only pairs that the similarity allows; these are aligned. Large buckets are cut in parts, and each pair of parts is a group.

So no candidate is left out: what steps 1 and 2 join need not be compared again, and step 3 sees all the rest.

Defined cases: null texts are in no class but their own; texts without words are equal only to equal texts; a document of fewer than K words is
one k-mer; rows that share an id are one document; null ids are left out of the classes and stay in ``deduplicate``; very long
texts are aligned whole; an empty table gives no rows; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm import align
from procmatch.llm.common import free_name, join_spread, slices, stored, tidied
from procmatch.llm.components import connected_components

K, PER_SKETCH, SKETCHES, SIMILARITY = 5, 2, 64, 0.8
#: Bins of the word pairs, and as many of the words, that stand for a text in step 3; rows of a bucket that are compared with as many others at once.
BINS, PART = 512, 2000
#: Bins of lengths for the ratio of lengths that the similarity allows.
LENGTHS = 3

_SEPARATORS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SEEDS = np.random.default_rng(11).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


#: The most that a bin counts.
FULL = 65_535


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SEPARATORS).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of words, each with the number of its occurrence."""
    if len(hashes) <= k:
        h = np.zeros(1, np.uint64)
        for x in hashes:
            h = _mixed(h + x)
        return h
    n = len(hashes) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _MIX[1] + hashes[i : i + n]
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    again = np.zeros(n, np.int64)
    same = h[order][1:] == h[order][:-1]
    if same.any():
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        again[order] = at - start
    return _mixed(h + again.astype(np.uint64) * _SEEDS[-1])


def sketches(grams: np.ndarray, count: int = SKETCHES, per: int = PER_SKETCH) -> np.ndarray:
    """A hash for each ordered list of the k-mers with the smallest hashes."""
    n = len(grams)
    if n > per:
        # A few hash functions at a time, so that long texts take no more memory than others.
        at, step = np.empty((count, per), np.int64), max(1, 100_000 // n)
        for k in range(0, count, step):
            h = (grams ^ _SEEDS[k : min(k + step, count), None]) * _SEEDS[count + k : min(count + k + step, 2 * count), None]
            h ^= h >> np.uint64(31)
            h *= _MIX[0]
            at[k : k + step] = np.sort(np.argpartition(h, per - 1, axis=1)[:, :per], axis=1)
    else:
        at = np.tile(np.arange(n), (count, 1))
    v = np.arange(count, dtype=np.uint64)
    for g in grams[at].T:
        v = _mixed(v * _MIX[1] + g)
    return v


def bag(codes: np.ndarray) -> np.ndarray:
    """How many of the word pairs (each word with its next) fall into each bin, and then how many of the words."""
    h = codes.astype(np.uint64)
    both = _mixed(h[:-1] * _MIX[1] + h[1:]) if len(h) > 1 else h[:0], _mixed(h)
    return np.concatenate([np.bincount((x % np.uint64(BINS)).astype(np.int64), minlength=BINS) for x in both])


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, n, codes, bands)``: the text's identity, its number of words, 32 bits for each word, its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                keys, sizes, codes, bands = [], [], [], []
                for text in batch.column(1).to_pylist():
                    ws = words(text)
                    key = xxhash.xxh3_128_hexdigest(b" ".join(ws) if ws else b"\0" + text.encode())
                    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
                    if key not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[key] = sketches(kmers(h)).view(np.int64) if ws else np.empty(0, np.int64)
                    keys.append(key)
                    sizes.append(len(ws))
                    codes.append((h >> np.uint64(32)).astype("<u4").tobytes())
                    bands.append(known[key])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "key", "n", "codes", "bands"])

    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(tidied(run), "id long, key string, n int, codes binary, bands array<long>")


def allowed(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor(n * (1 - similarity) + 1e-9).astype(np.int64)


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``(a, b)`` that link; ``texts``: ``(id, n, codes)``, one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            sides = [[np.frombuffer(x, "<u4") for x in batch.column(k).to_pylist()] for k in (2, 3)]
            most = allowed(np.array([max(len(a), len(b)) for a, b in zip(*sides, strict=True)]), similarity).tolist()
            ok = pa.array(align.within(list(zip(*sides, most, strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    side = lambda x: texts.select(F.col("id").alias(x), F.col("codes").alias(f"codes{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "codesa", "codesb").mapInArrow(tidied(run), "a long, b long")


def _fitting(pairs: DataFrame, similarity: float) -> DataFrame:
    """Different pairs ``(a, b)``, the smaller id first, of ``(x, y)``, structs of an id and its number of words, whose numbers of words allow the similarity."""
    near = pairs.where(F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity - 1e-9)
    return near.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _with_class(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "id")).drop("node", "component")


def _merged(parts: DataFrame, more: DataFrame) -> DataFrame:
    """``parts`` after its components have been joined by the edges ``more`` between documents."""
    end = lambda df, c: df.join(parts, F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("component", c)).drop("node", "component")
    up = stored(connected_components(end(end(more, "a"), "b")), "merged")
    moved = parts.join(up.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(moved.unionByName(up.join(parts.select("node"), "node", "left_anti")), "parts")


def _apart(now: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows whose bucket holds another class among the lengths that the similarity allows, more or less; all others have nothing to be compared with. ``now``: ``(band, id, words, class)``.

    Lengths fall into bins, ``LENGTHS`` of which are a little wider than the similarity, so texts that are similar lie at most so many bins from each other.
    A bucket's bins, each with its least and greatest class, are one list, no longer than the logarithm of the longest text; each row looks into it once, and rows of hot buckets stay where they are.
    """
    width = (1e-6 - math.log(similarity)) / LENGTHS
    placed = now.withColumn("bin", F.floor(F.log(F.greatest("words", F.lit(1))) / width).cast("int"))
    each = placed.groupBy("band", "bin").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"))
    lists = each.groupBy("band").agg(F.collect_list(F.struct("bin", "low", "high")).alias("held"), F.sum("n").alias("n"))
    other = F.exists("held", lambda h: (F.abs(h["bin"] - F.col("bin")) <= LENGTHS) & ((h["low"] != F.col("class")) | (h["high"] != F.col("class"))))
    return join_spread(placed, lists, "band").where(other).drop("bin", "held", "n")


def compatible(rows: DataFrame, codes: DataFrame, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """The pairs ``(a, b)`` of different classes in a bucket whose lengths and word pairs allow the similarity; of equal ones one.

    An edit touches one word and two word pairs, so similar texts of n words share all but as many words as they have edits, and all but twice as many of n - 1
    pairs. A bucket's rows are compared block by block, or part by part where they are more than ``part``.
    """
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                got = [np.minimum(bag(np.frombuffer(x, "<u4")), FULL).astype("<u2").tobytes() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["id", "bag"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["band", "p", "q", "n", "id"], ignore_index=True)
        held = np.stack([np.frombuffer(x, "<u2") for x in pdf["bag"]])
        ids, n, kind, own = (pdf[c].to_numpy() for c in ("id", "n", "class", "own"))
        keys = pdf[["band", "p", "q"]].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(pdf)]
        found = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            left, right = (x + np.flatnonzero(own[x:y] == keys[x, k]) for k in (1, 2))
            for at in range(0, len(left), 64):
                i = left[at : at + 64]
                # Rows lie in the order of their lengths, so what can be similar to the block is one stretch.
                j = right[(n[right] >= n[i[0]] * similarity - 1) & (n[right] * similarity - 1 <= n[i[-1]])]
                if not len(j):
                    continue
                most = np.maximum(n[i][:, None], n[j][None, :])
                ok = (kind[i][:, None] != kind[j][None, :]) & (np.minimum(n[i][:, None], n[j][None, :]) >= most * similarity - 1e-9)
                if keys[x, 1] == keys[x, 2]:
                    ok &= i[:, None] < j[None, :]
                u, v = np.nonzero(ok)
                for k in range(0, len(u), 10_000):
                    r, s = i[u[k : k + 10_000]], j[v[k : k + 10_000]]
                    longer = np.maximum(n[r], n[s])
                    pairs, single = np.minimum(held[r], held[s]).reshape(len(r), 2, BINS).sum(2, dtype=np.int64).T
                    edits = allowed(longer, similarity)
                    # A full bin may hold more than it says, but only in texts of more words than that.
                    good = (pairs >= longer - 1 - 2 * edits) & (single >= longer - edits) | (longer > FULL)
                    found.append((ids[r[good]], ids[s[good]]))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    texts = codes.join(rows.select("id").distinct(), "id", "left_semi").select("id", "codes").mapInArrow(tidied(bags), "id long, bag binary")
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"))
    total = rows.count()
    groups = F.lit(max(1, total // part))
    dealt = join_spread(rows.withColumnRenamed("n", "words"), sizes, "band").withColumn("parts", F.ceil(F.col("n") / part).cast("int")).drop("n").withColumnRenamed("words", "n")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    dealt = dealt.withColumn("group", F.when(F.col("parts") == 1, F.pmod("band", groups)).otherwise(F.xxhash64("band", "p", "q"))).join(texts, "id")
    return dealt.select("group", "band", "id", "n", "class", "own", "p", "q", "bag").groupBy("group").applyInPandas(compare, "a long, b long").distinct()


def links(texts: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Components ``(node, component)`` and the links ``(a, b)`` that were verified. ``texts``: ``sketched``, one row for each text."""
    own = F.struct("id", "n")
    rows = texts.select("id", F.col("n").alias("words"), F.explode("bands").alias("band"))
    lead = rows.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("id", F.col("words").alias("n"))).alias("lead")).where("n > 1")
    live = stored(join_spread(rows, lead, "band").select("band", "id", F.col("words").alias("n"), "lead"), "buckets")
    codes = stored(texts.select("id", "n", "codes").join(live.select("id").distinct(), "id", "left_semi"), "codes")
    pairs = stored(_fitting(live.where("id != lead.id").select(own.alias("x"), F.col("lead").alias("y")), similarity), "pairs")
    found = stored(similar(pairs, codes, similarity), "links")
    parts = stored(connected_components(found), "parts")

    rest = stored(_apart(_with_class(live.select("band", "id", F.col("n").alias("words")), parts), similarity), "apart")
    lead = rest.groupBy("band").agg(F.min_by(F.struct("id", F.col("words").alias("n"), "class"), F.xxhash64("id", "band")).alias("lead"), F.count("*").alias("n"))
    other = join_spread(rest, lead, "band").where(F.col("class") != F.col("lead.class")).select(F.struct("id", F.col("words").alias("n")).alias("x"), F.struct("lead.id", "lead.n").alias("y"))
    second = stored(_fitting(other, similarity).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = stored(similar(second, codes, similarity), "links")
    parts = _merged(parts, more)

    rest = stored(_apart(_with_class(rest.drop("class"), parts), similarity).withColumnRenamed("words", "n"), "apart")
    last = stored(compatible(rest, codes, similarity).join(pairs.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    final = stored(similar(last, codes, similarity), "links")
    return _merged(parts, final), found.unionByName(more).unionByName(final)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, rep_id)`` for each different non-null id: the class is its smallest id, ``rep_id`` the smallest id with the same words."""
    texts = stored(sketched(docs, id_col, text_col), "sketches")
    copies = stored(texts.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    member = stored(join_spread(texts.select("id", "key"), copies, "key").select("id", "rep").distinct(), "members")
    reps = texts.join(copies.select(F.col("rep").alias("id"), "key"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    twice = stored(member.join(member.groupBy("id").agg(F.count("*").alias("k")).where("k > 1"), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")), "twice")
    # Rows that share an id but not the text are one document: the text with the smallest key stands for it, and its class is joined with the others'.
    one = reps.groupBy("id").agg(F.min_by(F.struct("n", "codes", "bands"), "key").alias("t")).select("id", "t.*") if twice.take(1) else reps.drop("key")
    parts, _ = links(one, similarity)
    if twice.take(1):
        parts = _merged(parts, twice)
    placed = member.join(parts, F.col("rep") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"), F.min("rep").alias("rep_id"))
    alone = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("id")).distinct().join(member.select("id"), "id", "left_anti")
    return placed.unionByName(alone.select("id", F.col("id").alias("class_id"), F.col("id").alias("rep_id"))).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; of rows that share an id one stays."""
    name = free_name("gone", docs.columns)
    gone = stored(classes(docs, id_col, text_col, similarity).where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias(name)), "gone")
    kept = docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
    twice = stored(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name)).agg(F.count("*").alias(f"{name}_n")).where(F.col(f"{name}_n") > 1).select(name), "twice")
    if not twice.take(1):
        return kept
    same = F.col(id_col) == F.col(name)
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col]))
