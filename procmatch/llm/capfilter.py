"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a structured random product code: a vector's coordinates, turned at random, fall into ``BLOCKS`` blocks,
each with a codebook of random unit directions; a filter is a choice of one codeword a block, and a vector exceeds it if its product with
the joined codewords is above ``threshold``. List-decoding finds all filters that a vector exceeds from the few products with codewords,
without going through all filters. Vectors join on filter and label; a bucket is cut into parts of bounded size, pairs of parts are compared in
blocks, and each pair is verified and counted only at the first filter that both vectors exceed, so no pair is written out.

A code's filters have codewords in common, so a pair that misses one is likely to miss others; ``CODES`` codes, each turned by itself, are
joined. They grow with the number of different vectors, so that buckets keep their size, and get more filters until hardly
any of a sample of pairs at the cosine shares none: ``codes_for``. Where no label has more vectors than a bucket may hold, there is one filter that all
exceed, so all their pairs are compared. Equal vectors of a label are compared once, and their number counts.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with nothing; vectors link with those
of as many components only; rows that
share an id are one vector's links together; null ids are left as they are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import stored
from procmatch.llm.components import connected_components

COSINE, BLOCKS, SEED = 0.93, 2, 20240101
#: Vectors of a bucket that one task compares with as many others.
PART = 1500
#: Vectors of a bucket, codes turned by themselves, share of pairs at the cosine that may meet in no filter, pairs that measure it.
SIZE, CODES, MISS, SAMPLE = 600, 16, 0.002, 4000


class ProductCode:
    def __init__(self, dimension: int, codewords: int, threshold: float, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        cuts = [dimension * k // BLOCKS for k in range(BLOCKS + 1)]
        self.cuts = list(zip(cuts, cuts[1:], strict=False))
        self.books = []
        for a, b in self.cuts:
            book = rng.normal(size=(codewords, max(1, b - a)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(BLOCKS))
        self.threshold = threshold

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the filters that it exceeds, in order."""
        rows, filters = self.exceeded(unit)
        return np.split(filters, np.searchsorted(rows, np.arange(1, len(unit))))

    def exceeded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of unit vectors, filters that they exceed), in order.

        Codewords of the first block that even the best of the second can't lift above the threshold are not followed.
        """
        turned = unit @ self.turn
        first, second = (turned[:, a:b] @ book[:, : b - a].T for (a, b), book in zip(self.cuts, self.books, strict=True))
        n = second.shape[1]
        rows, live = np.nonzero(first + second.max(1, keepdims=True) >= self.threshold)
        step = max(1, (1 << 21) // n)
        out = []
        for at in range(0, len(rows), step):
            r, x = rows[at : at + step], live[at : at + step]
            i, j = np.nonzero(first[r, x][:, None] + second[r] >= self.threshold)
            out.append((r[i], x[i] * n + j))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int))


class TurnedCodes:
    """Product codes of one size, each turned by itself; their filters are numbered on."""

    def __init__(self, dimension: int, codewords: int, threshold: float, count: int = CODES) -> None:
        self.size = codewords**2
        self.codes = [ProductCode(dimension, codewords, threshold, SEED + k) for k in range(count)]

    def exceeded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, filters = zip(*(code.exceeded(unit) for code in self.codes), strict=True)
        rows, filters = np.concatenate(rows), np.concatenate([f + k * self.size for k, f in enumerate(filters)])
        order = np.argsort(rows, kind="stable")
        return rows[order], filters[order]


def _coordinates(dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values that a coordinate of a random unit vector takes, their shares, and those up to each value."""
    angle = np.linspace(-math.pi / 2, math.pi / 2, 40_001)
    share = np.cos(angle) ** (dimension - 2)
    return np.sin(angle), share / share.sum(), np.cumsum(share) / share.sum()


def missed(codes: TurnedCodes, dimension: int, cosine: float, pairs: int = SAMPLE) -> float:
    """The share of random pairs at ``cosine`` that exceed no filter together."""
    rng = np.random.default_rng(SEED)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    together = 0
    for at in range(0, pairs, 500):
        x, z = unit(rng.normal(size=(min(500, pairs - at), dimension))), rng.normal(size=(min(500, pairs - at), dimension))
        y = cosine * x + math.sqrt(1 - cosine**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
        one, other = (r * (len(codes.codes) * codes.size) + f for r, f in (codes.exceeded(v) for v in (x, y)))
        together += len(np.unique(np.intersect1d(one, other, assume_unique=True) // (len(codes.codes) * codes.size)))
    return 1 - together / pairs


def codes_for(vectors: int, dimension: int, cosine: float = COSINE, size: int = SIZE, miss: float = MISS) -> TurnedCodes:
    """Codes for buckets of about ``size`` vectors of which pairs at ``cosine`` meet in a filter but for ``miss`` of them.

    The threshold lets size / vectors of a filter's products pass. The number of filters starts from the share of pairs that pass one
    together, both as of random directions in this dimension, and rises until a sample of pairs meets.
    """
    if vectors <= max(size, PART):
        return TurnedCodes(dimension, 1, -2.0, 1)
    values, share, upto = _coordinates(dimension)
    threshold = float(np.interp(1 - size / vectors, upto, values))
    above = values >= threshold
    rest, _, rest_upto = _coordinates(max(2, dimension - 1))
    needed = (threshold - cosine * values[above]) / (math.sqrt(1 - cosine**2) * np.sqrt(np.maximum(1 - values[above] ** 2, 1e-12)))
    both = float((share[above] * (1 - np.interp(needed, rest, rest_upto))).sum())
    if both < size / vectors / 5:
        # In few dimensions a small cap hardly holds both of a pair.
        return codes_for(vectors, dimension, cosine, 2 * size, miss)
    found, count = 10.0, CODES
    while True:
        codes = TurnedCodes(dimension, max(2, math.ceil(math.sqrt(found / both / count))), threshold, count)
        if missed(codes, dimension, cosine) <= miss:
            return codes
        # More codewords say little in few dimensions, where more turns do.
        found, count = found * 1.25, count + 4


def _array(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def representatives(vectors: DataFrame, dimension: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Different usable vectors of a label: ``(rep, label, embedding, copies)``; ``rep`` is the smallest id."""
    return usable(vectors, dimension, id_col, vector_col, label_col).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def usable(vectors: DataFrame, dimension: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    clean = F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # -0.0 is 0.0
    return vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), clean.alias("embedding"))


def filtered(reps: DataFrame, code: TurnedCodes, dimension: int) -> DataFrame:
    """A row for each representative and filter that it exceeds, with all its filters: ``(label, filter, rep, copies, embedding, filters)``."""
    shared = reps.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                v = _array(batch.column("embedding"), dimension)
                v = v / np.abs(v).max(1, keepdims=True)
                take, found = shared.value.exceeded(v / np.linalg.norm(v, axis=1, keepdims=True))
                if len(take):
                    rows = batch.take(pa.array(take))
                    filters = pa.ListArray.from_arrays(pa.array(np.searchsorted(take, np.arange(len(v) + 1)).astype(np.int32)), pa.array(found.astype(np.int32))).take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(found.astype(np.int32)), rows.column("rep"), rows.column("copies"), rows.column("embedding"), filters], names=["label", "filter", "rep", "copies", "embedding", "filters"])

    kind = reps.schema["label"].dataType.simpleString()
    return reps.mapInArrow(run, f"label {kind}, filter int, rep long, copies long, embedding {reps.schema['embedding'].dataType.simpleString()}, filters array<int>")


def _earlier(left: list[np.ndarray], right: list[np.ndarray], f: int) -> np.ndarray:
    """Whether a vector of the left and one of the right share a filter below f."""
    rows = [[x[x < f] for x in side] for side in (left, right)]
    known = np.unique(np.concatenate(rows[0] or [np.empty(0, np.int32)]))
    held = []
    for side in rows:
        m = np.zeros((len(side), len(known) + 1), np.float32)
        at = np.repeat(np.arange(len(side)), [len(x) for x in side])
        of = np.concatenate(side or [np.empty(0, np.int32)])
        k = np.searchsorted(known, of)
        inside = (k < len(known)) & (known[np.minimum(k, len(known) - 1)] == of) if len(known) else np.zeros(len(of), bool)
        m[at[inside], k[inside]] = 1
        held.append(m)
    return held[0] @ held[1].T > 0


def _compare(ids: np.ndarray, copies: np.ndarray, units: np.ndarray, filters: np.ndarray, own: np.ndarray, f: int, p: int, q: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a group's vectors: copies that each links with here, and the smallest one that a chain of these links reaches.

    Pairs are verified block by block, and count only if they meet at no earlier filter.
    """
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    n, reach = np.zeros(len(ids), np.int64), np.arange(len(ids))
    pairs = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        near = units[rows] @ units[right].T >= cosine
        if p == q:
            near &= rows[:, None] < right[None, :]
        if near.any():
            i, j = (np.flatnonzero(near.any(k)) for k in (1, 0))
            near[np.ix_(i, j)] &= ~_earlier(list(filters[rows[i]]), list(filters[right[j]]), f)
            i, j = np.nonzero(near)
            pairs.append((rows[i], right[j]))
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        low = rank.copy()
        while True:
            was = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (low == was).all():
                break
        reach = np.argsort(ids, kind="stable")[low]
    return n, ids[reach]


def links(reps: DataFrame, dimension: int, cosine: float = COSINE, part: int = PART, batch: int = 4000) -> tuple[DataFrame, DataFrame]:
    """``(rep, n)``: copies of other representatives linked with each; and edges ``(a, b)`` that join what links.

    Buckets are compared together with others up to about ``batch`` rows a group; one with more than ``part`` vectors is cut in parts,
    and each pair of parts is a group.
    """
    n = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    rows = stored(filtered(reps, codes_for(n, dimension, cosine), dimension), "caps")
    # Most buckets are small and need no count at their rows; those to be cut are few, and their table joins as its size allows.
    large = stored(rows.groupBy("label", "filter").agg(F.count("*").alias("size")).where(F.col("size") > part).select("label", "filter", F.ceil(F.col("size") / part).cast("int").alias("parts")), "cap-sizes")
    groups = max(1, math.ceil(rows.count() / batch))
    dealt = rows.join(large, ["label", "filter"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other"), "bucket": F.xxhash64("label", "filter")})
    dealt = dealt.withColumn("group", F.when(F.col("parts") == 1, F.pmod("bucket", F.lit(groups))).otherwise(F.xxhash64("bucket", "p", "q"))).select("group", "bucket", "filter", "p", "q", "own", "rep", "copies", "embedding", "filters")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "p", "q", "rep"], ignore_index=True)
        keys = pdf[["bucket", "p", "q"]].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(pdf)]
        units, filters = np.stack(pdf["embedding"].to_list()).astype(float), pdf["filters"].to_numpy()
        units /= np.abs(units).max(1, keepdims=True)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        ids, copies, own, fs = (pdf[c].to_numpy() for c in ("rep", "copies", "own", "filter"))
        got = [_compare(ids[a:b], copies[a:b], units[a:b], filters[a:b], own[a:b], int(fs[a]), int(keys[a, 1]), int(keys[a, 2]), cosine) for a, b in zip(cuts, cuts[1:], strict=False)]
        out = pd.DataFrame({"rep": ids, "n": np.concatenate([g[0] for g in got]), "near": np.concatenate([g[1] for g in got])})
        return out[out["n"] > 0]

    found = stored(dealt.groupBy("group").applyInPandas(compare, "rep long, n long, near long"), "cap-links")
    return found.groupBy("rep").agg(F.sum("n").alias("n")), found.where("near != rep").select(F.col("rep").alias("a"), F.col("near").alias("b")).distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row."""
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    sizes = [r["d"] for r in slim.where(F.size("embedding") > 0).select(F.size("embedding").alias("d")).distinct().collect()]
    linked = None
    for d in sorted(sizes):
        part = stored(_linked(slim.where(F.size("embedding") == d), d, cosine), "cap-members")
        linked = part if linked is None else linked.unionByName(part)
    if linked is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = linked.groupBy("_id").agg(F.max("_n").alias("_n"), F.min("_c").alias("_c"))
    own = F.coalesce("_c", "vec_id")
    return slim.join(linked, F.col("vec_id") == F.col("_id"), "left").select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


def _linked(slim: DataFrame, dimension: int, cosine: float) -> DataFrame:
    """``(_id, _n, _c)``: links and component of the usable vectors of one length."""
    if dimension < BLOCKS:
        # Components more, which are 0, change no cosine; so that each block of the code has one.
        none = F.array_repeat(F.lit(0).cast(slim.schema["embedding"].dataType.elementType), BLOCKS - dimension)
        slim, dimension = slim.withColumn("embedding", F.concat("embedding", none)), BLOCKS
    reps = stored(representatives(slim, dimension), "cap-reps")
    counts, edges = links(reps, dimension, cosine)
    parts = connected_components(edges)
    member = usable(slim, dimension, "vec_id", "embedding", "label").join(reps, ["label", "embedding"]).select("vec_id", "rep", "copies").distinct()
    placed = member.join(counts, "rep", "left").join(parts, member["rep"] == parts["node"], "left")
    return placed.select(F.col("vec_id").alias("_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("_n"), F.coalesce("component", "rep").alias("_c"))
