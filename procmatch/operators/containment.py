"""Which texts contain which strings, by an index of character grams in place of comparing every text with every string."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.sources.shared import stored

GRAM = 3
#: Terms and their characters that an automaton is built of, in each Python worker.
TERMS, CHARS = 1_000_000, 32_000_000


def grams(c: Column, size: Column | int) -> Column:
    """The different runs of ``size`` characters; none of a shorter text."""
    n = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.array_distinct(F.when(F.length(c) >= n, F.transform(places, lambda i: c.substr(i, n))).otherwise(F.array().cast("array<string>")))


def contained(texts: DataFrame, strings: DataFrame, text: str = "text", string: str = "string", size: int = GRAM) -> DataFrame:
    """The pairs ``(text, string)`` of different texts and different, not empty strings of which the text contains the string."""
    return looked_at(texts, strings, text, string, size).where(F.contains(text, string))


def looked_at(texts: DataFrame, strings: DataFrame, text: str = "text", string: str = "string", size: int = GRAM) -> DataFrame:
    """The pairs that ``contained`` chooses from.

    Of each string the gram that fewest texts have is its key; texts that have it are looked at, no others. A gram is over half as long as its string: of
    ``size`` characters, twice as many, four times and so on, so that a gram's texts don't grow more numerous with the tables where strings tell more apart. Strings
    shorter than ``size`` are keys of their own length. A string with a gram that no text has meets nothing.
    """
    doubled = (F.lit(size) * F.pow(F.lit(2), F.length(F.bin(F.floor(F.length("_s") / size))) - 1)).cast("int")
    wanted = stored(strings.where(F.length(string) > 0).select(F.col(string).alias("_s")).distinct().withColumn("_k", F.when(F.length("_s") < size, F.length("_s")).otherwise(doubled)), "strings")
    lengths = sorted(r["_k"] for r in wanted.select("_k").distinct().collect())  # ``size`` and the logarithm of the longest string
    every = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_t")).distinct()
    index = stored(every.select("_t", F.explode(F.concat(*[grams(F.col("_t"), k) for k in lengths] or [F.array().cast("array<string>")])).alias("_g")), "grams")
    often = index.groupBy("_g").agg(F.count("*").alias("_n"))
    own = wanted.select("_s", F.explode(grams(F.col("_s"), F.col("_k"))).alias("_g")).join(often, "_g", "left")
    rarest = own.groupBy("_s").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("r")).where("r.n > 0").select("_s", "r._g")
    return rarest.join(index, "_g").select(F.col("_t").alias(text), F.col("_s").alias(string))


def with_terms(texts: DataFrame, terms: DataFrame, text: str, name: str = "found", most: int = TERMS, chars: int = CHARS) -> DataFrame:
    """``texts`` with an array of the ``ord`` of all terms ``(ord, term)`` that each text contains, ascending; empty terms are in every text, null texts hold none.

    One automaton of all terms finds them in one pass over a text, however many terms there are. More terms than ``most``, or longer ones than
    ``chars`` together, are found by ``contained``.
    """
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    kind = terms.schema["ord"].dataType.simpleString()
    if size["n"] > most or size["chars"] > chars:
        pairs = contained(texts.select(F.col(text).alias("_text")), terms, "_text", "term")
        empty = terms.where(F.length("term") == 0).agg(F.collect_list("ord").alias("_empty"))
        hits = pairs.join(terms, "term").groupBy("_text").agg(F.collect_list("ord").alias("_hits"))
        none = F.array().cast(f"array<{kind}>")
        both = texts.join(hits, F.col(text) == F.col("_text"), "left").crossJoin(F.broadcast(empty))
        return both.withColumn(name, F.when(F.col(text).isNull(), none).otherwise(F.array_sort(F.concat(F.coalesce("_hits", none), "_empty")))).drop("_text", "_hits", "_empty")
    shared = texts.sparkSession.sparkContext.broadcast([(r["term"], r["ord"]) for r in terms.where("term is not null").select("term", "ord").collect()])
    columns, place = texts.columns, texts.columns.index(text)
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known: dict[str, list] = {}
        for term, number in shared.value:
            known.setdefault(term, []).append(number)
        always = known.pop("", [])
        automaton = ahocorasick.Automaton()
        for term, numbers in known.items():
            automaton.add_word(term, numbers)
        if known:
            automaton.make_automaton()
        for batch in batches:
            found = []
            for t in batch.column(place).to_pylist():
                hits = {n for _, numbers in automaton.iter(t) for n in numbers} if t and known else set()
                found.append(sorted(hits | set(always)) if t is not None else [])
            kept = [pa.array(found, pa.list_(pa.int64() if kind == "bigint" else pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *kept], names=[*columns, name])

    return texts.mapInArrow(run, f"{form}, `{name}` array<{kind}>")


def expand_by_table(queries: DataFrame, terms: DataFrame, query_id: str = "query_id", query: str = "query", most: int = TERMS) -> DataFrame:
    """Queries with the words of all dictionary terms ``(ord, term, words)`` that they contain, each word once, in the order of the dictionary; ``expand_query`` for a dictionary of any size."""
    asked = queries.withColumn("_plain", F.trim(query))
    found = with_terms(asked, terms, "_plain", "_ords", most)
    words = terms.select("ord", "words")
    each = found.select(query_id, F.explode(F.array_distinct("_ords")).alias("ord")).join(words, "ord")
    more = each.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("ord", "words"))).alias("h")).select(query_id, F.array_join(F.array_distinct(F.flatten(F.col("h.words"))), " ").alias("_more"))
    got = asked.join(more, query_id, "left")
    return got.withColumn("expanded", F.when(F.coalesce("_more", F.lit("")) == "", F.col("_plain")).otherwise(F.concat_ws(" ", "_plain", "_more"))).drop("_more", "_plain")
