"""BM25's k best documents without scoring every posting: postings in the order of their impact, in blocks that know their greatest.

Documents are dealt to shards of bounded size. In a shard, a query's terms are taken in the order of the most that they can add. A block is read whole
only while a document not met before could still come among the k best by it; of all later blocks and terms only those documents are looked up
that still can. What is skipped can't change the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmatch.operators.lexical import B, K1, LexicalIndex, query_terms
from procmatch.sources.shared import stored

#: Documents of a shard, postings of a block, queries that a task takes.
SHARD, BLOCK, QUERIES = 20_000, 128, 1024
#: Documents looked at for each of the k, when so much of what all terms can add is read.
PROBE, PROBED_AT = 16, 0.7


@dataclass
class ImpactIndex:
    """``blocks`` (shard, term, block, top, docs, shares): ``shares``, what a document adds at weight 1, fall from block to block; ``terms`` (term, df, idf); ``stats`` one row (n, avgdl)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Blocks sorted by term, so that a query's terms prune row groups."""
        self.blocks.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard", "block").write.mode("overwrite").parquet(f"{path}/blocks")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark, path: str) -> ImpactIndex:
        return ImpactIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("blocks", "terms", "stats")))


def build(index: LexicalIndex, k1: float = K1, b: float = B, shard: int = SHARD, block: int = BLOCK) -> ImpactIndex:
    """A shard holds some ``shard`` documents, so a term's postings in it are a bounded list. Weights must not be negative."""
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    shards = F.greatest(F.ceil(F.col("n") / shard), F.lit(1))
    dealt = index.postings.join(F.broadcast(index.stats)).select(F.pmod(F.xxhash64("doc_id"), shards).cast("int").alias("shard"), "term", (-share).alias("less"), "doc_id")
    lists = dealt.groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("less", "doc_id"))).alias("p"))
    cut = lists.select("shard", "term", "p", F.explode(F.sequence(F.lit(0), ((F.size("p") - 1) / block).cast("int"))).alias("block"))
    cut = cut.select("shard", "term", "block", F.slice("p", F.col("block") * block + 1, F.lit(block)).alias("p"))
    return ImpactIndex(cut.select("shard", "term", "block", (-F.col("p")[0]["less"]).alias("top"), F.transform("p", lambda x: x["doc_id"]).alias("docs"), F.transform("p", lambda x: -x["less"]).alias("shares")), index.terms, index.stats)


class Postings:
    """A term's postings in a shard: by impact, for reading, and by document, for looking up."""

    def __init__(self, docs: np.ndarray, shares: np.ndarray, tops: np.ndarray, ends: np.ndarray):
        self.docs, self.shares, self.tops, self.ends = docs, shares, tops, ends
        order = np.argsort(docs, kind="stable")
        self.by_doc, self.by_share = docs[order], shares[order]

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, int]:
        """Shares of ``docs``, 0 without a posting, and how many have one."""
        at = np.minimum(np.searchsorted(self.by_doc, docs), len(self.by_doc) - 1)
        hit = self.by_doc[at] == docs
        return np.where(hit, self.by_share[at], 0.0), int(hit.sum())


def best(lists: list[tuple[float, Postings]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best documents of one query in a shard: ``(documents, scores, postings scored)``, ties to smaller documents. ``lists``: weights and postings of its terms.

    Terms that add much for few postings come first. Once those left can't lift a new document to the k-th best score, no new one is taken up; in the
    list where that happens, block by block. A look at the most promising documents, ``PROBE`` of them for each of the k, raises the
    k-th best score to nearly its end before the long lists come.
    """
    lists = sorted(lists, key=lambda x: -x[0] * x[1].tops[0] / len(x[1].docs))
    rest = np.append(np.cumsum([w * p.tops[0] for w, p in lists][::-1])[::-1], 0.0)
    got, met = np.zeros(n_docs), np.zeros(n_docs, bool)
    scored, slack = 0, 1e-8
    least = max((w * p.shares[k - 1] for w, p in lists if len(p.shares) >= k), default=-np.inf)
    probed = False
    for i, (w, p) in enumerate(lists):
        if not probed and rest[i] <= (1 - PROBED_AT) * rest[0]:
            probed, first = True, np.flatnonzero(met)
            first = first[np.argsort(-got[first], kind="stable")[: PROBE * k]]
            sums = got[first]
            for v, other in lists[i:]:
                shares, hits = other.of(first)
                sums, scored = sums + v * shares, scored + hits
            if len(first) >= k:
                least = max(least, float(np.partition(sums, -k)[-k]))
        if rest[i + 1] >= least - slack:
            end = len(p.docs)
        elif rest[i] >= least - slack:
            blocks = int(np.searchsorted(-(w * p.tops + rest[i + 1]), -(least - slack), "right"))
            end = int(p.ends[blocks - 1]) if blocks else 0
        else:
            end = 0
        if end < len(p.docs):
            # No document that isn't met by now can count: none is taken up below, and those that no longer can are let go.
            met &= got + rest[i] >= least - slack
            can = np.flatnonzero(met)
            shares, hits = p.of(can)
            if end:
                head = np.zeros(n_docs, bool)
                head[p.docs[:end]] = True
                shares, hits = np.where(head[can], 0.0, shares), int((shares > 0).sum() - (head[can] & (shares > 0)).sum())
            got[can] += w * shares
            scored += hits
        got[p.docs[:end]] += w * p.shares[:end]
        met[p.docs[:end]] = True
        scored += end
        seen = got[met]
        if len(seen) >= k:
            least = max(least, float(np.partition(seen, -k)[-k]))
    can = np.flatnonzero(met & (got >= least - slack))
    order = np.lexsort((can, -np.round(got[can], 9)))[:k]
    return can[order], got[can[order]], scored


def _shard(queries: pa.Table, blocks: pa.Table, k: int, names: list[str]) -> pa.Table:
    """All queries of a part over one shard's blocks."""
    lists = blocks.column("docs").combine_chunks()
    values = lists.flatten()
    known = values.unique()
    known = known.take(pc.sort_indices(known))  # documents are numbered in the order of their ids
    code = pc.index_in(values, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
    shares, size = blocks.column("shares").combine_chunks().flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    starts, tops = np.cumsum(size) - size, blocks.column("top").to_numpy()
    term, number = blocks.column("term").to_pylist(), blocks.column("block").to_numpy()
    rows: dict[str, list[int]] = {}
    for i in np.argsort(number, kind="stable"):
        rows.setdefault(term[i], []).append(int(i))
    held: dict[str, Postings] = {}

    def postings(t: str) -> Postings | None:
        if t not in held and t in rows:
            at = np.concatenate([np.arange(starts[i], starts[i] + size[i]) for i in rows[t]])
            held[t] = Postings(code[at], shares[at], tops[rows[t]], np.cumsum(size[rows[t]]))
        return held.get(t)

    who, docs, scores, every, done = [], [], [], [], []
    for q, (terms, weights) in enumerate(zip(queries.column("terms").to_pylist(), queries.column("weights").to_pylist(), strict=True)):
        own = [(w, p) for t, w in sorted(zip(terms, weights, strict=True)) if (p := postings(t)) is not None]
        if own:
            d, s, n = best(own, len(known), k)
            who += [q] * len(d)
            docs.append(d)
            scores.append(s)
            every += [sum(len(p.docs) for _, p in own)] * len(d)
            done += [n] * len(d)
    ids = queries.column("query_id").combine_chunks()
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.Table.from_arrays([ids.take(pa.array(who, pa.int64())), known.take(pa.array(join(docs, np.int64))), pa.array(join(scores, float)), pa.array(every, pa.int64()), pa.array(done, pa.int64())], names=names)


def found(index: ImpactIndex, queries: DataFrame, k: int, part: int = QUERIES) -> DataFrame:
    """``(query_id, doc_id, score, postings, scored, shard)``: each shard's k best of each query ``(query_id, tokens)``, with how many postings its terms have there and how many were scored."""
    weighed = query_terms(queries).join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    asked = weighed.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    n, docs = queries.count(), index.stats.select("n").first()["n"]
    shards = max(1, index.blocks.agg(F.max("shard")).first()[0] or 0) + 1 if docs else 1
    cores = queries.sparkSession.sparkContext.defaultParallelism
    # Few shards are each searched by several tasks, each with its part of the queries.
    parts = max(1, -(-n // part), min(n, -(-cores // shards)))
    asked = stored(asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), "asked")
    wanted = asked.select(F.col("part").alias("wanted_by"), F.explode("terms").alias("term")).distinct()
    held = index.blocks.join(wanted, "term").select(F.col("shard").alias("in_shard"), "wanted_by", "term", "block", "top", "docs", "shares")
    spread = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "part", "query_id", "terms", "weights")
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": index.blocks.schema["docs"].dataType.elementType.simpleString()}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, postings long, scored long, shard int"
    names = ["query_id", "doc_id", "score", "postings", "scored"]
    form = queries.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return form.empty_table()
        got = _shard(a, b, k, names)
        return got.append_column("shard", pa.array([key[0].as_py()] * got.num_rows, pa.int32())).cast(form)

    return spread.groupBy("shard", "part").cogroup(held.groupBy("in_shard", "wanted_by")).applyInArrow(run, schema)


def search(index: ImpactIndex, queries: DataFrame, k: int, part: int = QUERIES) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the k best documents that share a term with the query; scores tie at 9 places, ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return found(index, queries, k, part).select("query_id", "doc_id", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def work(index: ImpactIndex, queries: DataFrame, k: int, part: int = QUERIES) -> DataFrame:
    """One row ``(postings, scored)``: postings of the queries' terms, and those that a search scores."""
    each = found(index, queries, k, part).groupBy("query_id", "shard").agg(F.max("postings").alias("postings"), F.max("scored").alias("scored"))
    return each.agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored"))
