"""Spelling variants: words one edit apart, found by pivotal bigrams, each word led to the frequent form that it stands for.

Words of the whole corpus are counted first; all that follows works on distinct words. Each word gives, in the order of
how rare its bigrams are, the three rarest occurrences as its prefix, and of these two disjoint ones, the cheapest by
dynamic programming, as its pivots. One edit spoils at most one of two disjoint pivots. If it lies right of the left pivot,
that pivot and all before it stand unchanged in the other word; else the right pivot and all after it do. So a left pivot is
looked up with the text up to its end, a right pivot with the text from its start, which is the position limit at its
tightest. The pivots of the word whose prefix ends with the rarer bigram lie in the other word's prefix, so pivots are joined
with prefixes of all words, and what meets is verified by its edit distance. Nothing is left out; only DataFrame functions run.

Null texts have no words, a null id counts as an empty one, repeated rows count again. Other columns are not looked at, whatever
their names. A table without words gives no rows. Ties of counts go to the smaller word in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import stored

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of at least so many code points and occurrences; a form has at least RATIO times its word's; every SLIP-th occurrence loses a letter.
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: Grams that one edit can spoil, and one more.
PREFIX = 3


def words(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, slip: int | None = SLIP) -> DataFrame:
    """``word``, a row for each occurrence of ``least_length`` code points or more.

    ``slip``: where it divides the crc32 of ``<id>:<run>``, the run loses the code point at that number modulo its length;
    None: runs stay as they are. A shorter run can't give a longer word, so such runs are passed over at once.
    """
    runs = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if slip is None:
        return runs.select(F.col("run").alias("word"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    return hashed.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)


def vocabulary(occurrences: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words with ``least_count`` occurrences or more; counts are summed before they are shuffled."""
    return occurrences.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _pivots(grams: Column) -> Column:
    """Of bigrams ``(at, cost)`` by place: the disjoint two of least cost, as a struct ``(cost, a, b)``.

    One pass: ``one`` is the cheapest bigram that ends before the present one starts, ``last`` the one before, which
    may overlap.
    """
    none = F.lit(None).cast("struct<cost: bigint, at: int>")
    start = F.struct(none.alias("one"), none.alias("last"), F.lit(None).cast("struct<cost: bigint, a: int, b: int>").alias("two"))

    def step(s: Column, g: Column) -> Column:
        own = F.struct(g["cost"].alias("cost"), g["at"].alias("at"))
        before = F.when(s["last"]["at"] <= g["at"] - 2, F.least(s["one"], s["last"])).otherwise(s["one"])
        both = F.when(before.isNotNull(), F.struct((before["cost"] + g["cost"]).alias("cost"), before["at"].alias("a"), g["at"].alias("b")))
        return F.struct(F.least(s["one"], s["last"]).alias("one"), own.alias("last"), F.least(s["two"], both).alias("two"))

    return F.aggregate(grams, start, step, lambda s: s["two"])


def signatures(vocab: DataFrame) -> DataFrame:
    """``(word, n, prefix, pivots)`` of distinct words of at least four letters: ``prefix`` holds the places of the rarest bigrams, all occurrences
    of each bigram in it; ``pivots`` the places ``a`` and ``b`` of the two disjoint ones.

    A bigram's cost is the number of words that hold it. Bigrams of ``LETTERS`` without A to Z are at most 90 squared, so their table is broadcast.
    """
    grams = vocab.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("at", "gram"))
    cost = grams.groupBy("gram").agg(F.count("*").alias("cost"))
    ranked = grams.join(F.broadcast(cost), "gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("cost", "gram", "at"))).alias("g"))
    last = F.element_at("g", PREFIX)
    prefix = F.filter("g", lambda x: (x["cost"] < last["cost"]) | (x["cost"] == last["cost"]) & (x["gram"] <= last["gram"]))
    placed = ranked.select("word", "n", F.array_sort(F.transform(prefix, lambda x: F.struct(x["at"].alias("at"), x["cost"].alias("cost")))).alias("p"))
    return placed.select("word", "n", F.transform("p", lambda x: x["at"]).alias("prefix"), _pivots(F.col("p")).alias("pivots"))


def near_words(vocab: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` of distinct words ``(word, n)``: all words one inserted, deleted or replaced code point away, both ways round.

    Keys are a side and a word's text up to or from a bigram; candidates meet where a pivot's key is another word's prefix key.
    """
    sign = stored(signatures(vocab), "grams")
    left = lambda at: F.struct(F.lit("l").alias("side"), F.col("word").substr(F.lit(1), at + 2).alias("part"))
    right = lambda at: F.struct(F.lit("r").alias("side"), F.col("word").substr(at + 1, F.length("word")).alias("part"))
    pivots = sign.select("word", "n", F.explode(F.array(left(F.col("pivots.a")), right(F.col("pivots.b")))).alias("k")).select("word", "n", "k.side", "k.part")
    prefixes = sign.select("word", "n", F.explode(F.flatten(F.transform("prefix", lambda at: F.array(left(at), right(at))))).alias("k")).select(F.col("word").alias("near"), F.col("n").alias("near_n"), "k.side", "k.part")
    met = pivots.join(prefixes, ["side", "part"]).where((F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1))
    ways = met.select(F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("w"))
    return ways.select("w.*").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of links ``(word, form)``, at most one from each word and none in a circle: the last word on the way.

    Each round doubles how far a word sees, so a chain of n links takes about log n rounds.
    """
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not now.join(onward, "root", "left_semi").take(1):
            return now
        now = stored(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int | None = None) -> DataFrame:
    """A row ``(word, form, root, n, n_near, form_n)`` for each word of ``docs`` with enough letters and occurrences.

    ``form``: the most frequent near word, if it occurs ``ratio`` times as often or more, else null; ``root``: where the forms lead, the
    word itself if nowhere; ``n_near``: how many words are near. Ratios above 1 make counts rise from form to form, so there is no circle.
    """
    if least_length < 4 or ratio < 2:
        raise ValueError("words need four letters for two disjoint bigrams, ratios must be 2 or more")
    vocab = stored(vocabulary(words(docs, doc, text, least_length, slip), least_count), "words")
    # The least of (-count, word): the largest count, of equal ones the smallest word.
    near = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    formed = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("top.less") >= ratio * F.col("n"), F.col("top")).alias("top"))
    formed = stored(formed.select("word", "n", "n_near", F.col("top.near").alias("form"), (-F.col("top.less")).alias("form_n")), "forms")
    led = roots(formed.where("form is not null"))
    return formed.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
