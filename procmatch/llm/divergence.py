"""How far the sources of a language differ in their words: exact counts of terms, scaled to whole billionths, compared by chi-square-like terms.

Each document becomes a sparse vector of term counts, as ``CountVectorizer`` makes it with ``minDF`` and the largest vocabulary there can be, and vectors
are summed by language and source as they arise, as ``Summarizer`` sums them. A vector's entries are (term, count) rather than (place, count), and a term's number of
documents is summed beside its count: so one pass over the text gives the vocabulary and the sums, no vocabulary stands on the driver or in every
task, and no buffer has its width. Terms in fewer documents than asked for go before anything else is worked out. The tests compare with ``CountVectorizer`` itself.

For a pair of sources a and b and f(p, q) = (p - q)^2 div q, terms that one or both lack all have the same p, so
  sum f(p, q) = sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)] + sum over a's terms [f(p, q0) - f(p0, q0)] + sum over b's terms [f(p0, q) - f(p0, q0)] + V f(p0, q0).
The first sum is taken over common terms in blocks; the others need only how often each p occurs in a source. All figures are whole numbers.

Null text, language and source count as empty, repeated rows as further documents; ids and other columns aren't looked at. Groups without terms have p of
a count of 0; a language without kept terms has no terms and pairs of value 0. An empty table gives no rows. Equal values rank by item in the order of UTF-8.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmatch.llm.common import slices, stored, tidied

#: In UTF-8, after A to Z have become small: letters, and all that isn't ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Sums that a task holds before it hands them on; rows (term, source) of a block of terms; pairs worked out at once; parts that a language's pairs are dealt to.
HELD, BLOCK, CHUNK, SALT = 400_000, 100_000, 1_000_000, 16


@dataclass
class Counts:
    """``groups`` (lang, source, total), ``langs`` (lang, v, total), ``terms`` (lang, source, term, n, all_n) with n > 0; total: occurrences of kept terms; all_n: those in the language."""

    groups: DataFrame
    langs: DataFrame
    terms: DataFrame


def sums(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of terms and documents with them, summed in tasks; a row of an empty term for each group and task, so that groups without terms are there."""

    def rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            same = lambda x: pa.array([x] * len(n), pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                terms = TERM.findall(text.encode().lower())
                key = lang, source
                if key not in groups:
                    groups[key] = Counter({b"": 0}), Counter()
                n, docs = groups[key]
                was = len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - was
            if size > held:
                yield from rows(groups)
                groups, size = {}, 0
        yield from rows(groups)

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def count(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, held: int = HELD) -> Counts:
    """Counts of the terms in ``min_docs`` documents of their language or more, for each language and source.

    One shuffle, by term: groups' sums and the language's then lie in the same task.
    """
    dealt = sums(docs, text, lang, source, held).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    first = F.row_number().over(w.orderBy("source")) == 1
    every = dealt.withColumns({"all_n": F.sum("n").over(w), "all_docs": F.sum("docs").over(w), "first": first})
    kept = stored(every.where((F.col("term") == "") | (F.col("all_docs") >= min_docs)).select("lang", "source", "term", "n", "all_n", "first"), "counts")
    # Rows of the empty term add 0 and stand for the group.
    groups = stored(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), "groups")
    langs = stored(kept.groupBy("lang").agg(F.count_if(F.col("first") & (F.col("term") != "")).alias("v"), F.sum("n").alias("total")), "langs")
    return Counts(groups, langs, kept.where("term <> ''").drop("first"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + v)), in decimals, since the product can leave 64 bits; 1 where there are no terms."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    parts = (total + v).cast("decimal(19,0)")
    return F.when(total + v > 0, F.call_function("div", whole, parts) + 1).otherwise(F.lit(1)).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares stay within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_ranks(c: Counts, top: int = TOP) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms that mark each source most, against its whole language."""
    sizes = c.groups.join(c.langs.select("lang", "v", F.col("total").alias("all_total")), "lang")
    q = share(F.col("all_n"), F.col("all_total"), F.col("v"))
    own = c.terms.join(sizes, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), q.alias("q"))
    marked = own.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return marked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _common(batch: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of one block of terms ``(term, source, p, p0)``: for each pair of sources the first sum above, in parts of CHUNK pairs."""
    coded = lambda c: batch.column(c).combine_chunks().dictionary_encode()
    names, code, term = coded("source").dictionary, coded("source").indices.to_numpy().astype(np.int64), coded("term").indices.to_numpy()
    order = np.argsort(term, kind="stable")
    code, p, p0 = code[order], batch.column("p").to_numpy()[order], batch.column("p0").to_numpy()[order]
    starts, lengths = np.unique(term[order], return_index=True, return_counts=True)[1:]
    first, size = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    ends, at = np.cumsum(size), 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = size[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = np.repeat(first[at:to], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        a, b = a[code[a] != code[b]], b[code[a] != code[b]]
        f = lambda x, y: (x - y) ** 2 // y
        value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
        pairs, where = np.unique(code[a] * len(names) + code[b], return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, where, value)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), pa.array(total)], names=["source", "item", "value"])
        at = to


def pair_ranks(c: Counts, block: int = BLOCK, salt: int = SALT) -> DataFrame:
    """``(lang, source, item, value, rank)``: all other sources of a language by how far a source's words lie from theirs."""
    groups = c.groups.join(c.langs.select("lang", "v"), "lang").select("lang", "source", "total", "v", share(F.lit(0), F.col("total"), F.col("v")).alias("p0"))
    own = stored(c.terms.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0"), "shares")
    # Sum over common terms: a term's sources meet in its block.
    blocks = stored(own.groupBy("lang").agg((F.count("*") / block + 1).cast("int").alias("blocks")), "blocks")
    dealt = own.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    kind = "lang string, source string, item string, value long"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = list(_common(table))
        got = pa.Table.from_batches(parts, schema=parts[0].schema)
        return got.add_column(0, "lang", pa.array([key[0].as_py()] * got.num_rows, pa.string()))

    common = dealt.select("lang", "block", "term", "source", "p", "p0").groupBy("lang", "block").applyInArrow(run, kind)
    # Sums over the terms of one side: by how often each p occurs, dealt in parts so that a large language isn't one task's.
    often = own.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")).withColumn("part", F.pmod(F.xxhash64("source", "p"), F.lit(salt)).cast("int"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("part"))
    met = often.join(other, ["lang", "part"]).where("source <> item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    left = met.select("lang", "source", "item", (F.col("m") * (apart(p, q0) - apart(p0, q0))).alias("value"))
    right = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (apart(q0, p) - apart(q0, p0))).alias("value"))
    # Every pair, with all terms as if both lacked them.
    dealt_groups = groups.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(salt)).cast("int"))
    none = dealt_groups.join(other, ["lang", "part"]).where("source <> item").select("lang", "source", "item", (F.col("v") * apart(p0, q0)).alias("value"))
    totals = common.unionByName(left).unionByName(right).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return totals.withColumn("rank", F.row_number().over(w))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` of ``pair_ranks``, part ``term`` of ``term_ranks``."""
    c = count(docs, text, lang, source, min_docs)
    rows = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return rows(pair_ranks(c), "pair").unionByName(rows(term_ranks(c, top), "term"))
