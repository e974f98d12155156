"""Brown's class-based bigrams: words have classes, classes follow each other, and a class emits its words.

The classes come from exchange clustering in two steps. First the driver clusters ``ITEMS`` items over their bigram table, which their
number bounds: the most frequent words, and for all other words one item for each of the most frequent pairs of last letters, and one for the
rest. Then each of the ``VOCABULARY`` most frequent words moves to the class that its own neighbours make likeliest: Spark sums, over all training texts,
how often each class stands before and after each word, and how often a word follows itself, and tasks make the exchange for their words with the others'
classes held. Moves that together would lower the likelihood aren't all made: ``settled`` counts again and takes the best of them, so it never falls.
Rarer words keep the class of their ending. All counts are of the whole training text, summed in Spark; class bigrams are counted again after the moves.

P(w | v) = P(class w | class v) * P(w | class w), with
P(d | c) = (n(c, d) + A * P(d)) / (n(c) + A) and P(w | c) = (n(w) + 1) / (N(c) + V(c) + 1), A = SMOOTHING;
N and V count a class's tokens and distinct words, and each class keeps one share for unseen words. A text starts after an end token.

Null and empty texts are one end token; a null id is trained on and scored like others; repeated rows count each; texts of
any length count whole; an empty table gives no rows, and with nothing to train on all counts are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import slices, stored, tidied

WORD_ITEMS, ENDING_ITEMS, CLASSES, SMOOTHING = 800, 222, 48, 5.0
#: Words that move by their own neighbours.
VOCABULARY = 30_000
#: Words whose counts are broadcast; the counts of all others are joined.
HEAD = 100_000
#: Distinct words that a task counts before it hands them on.
BUFFER = 150_000
END = b"\n"  # no word holds it


def tokens(text: str | None) -> list[bytes]:
    return [*text.encode().lower().split(), END] if text else [END]


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of the one column of ``texts``; the end token's word is a line break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["word", "n"])
            got.clear()
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                got.update(tokens(text))
                if len(got) > BUFFER:
                    yield flush()
        if got:
            yield flush()

    return texts.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Items:
    """Which item a word is."""

    def __init__(self, words: list[str], endings: list[str]) -> None:
        self.words = {w.encode(): k for k, w in enumerate(words)}
        self.endings = {e: len(words) + k for k, e in enumerate(endings)}
        self.rest = len(words) + len(endings)
        self.count = self.rest + 1

    def __call__(self, word: bytes) -> int:
        k = self.words.get(word)
        return k if k is not None else self.endings.get(word.decode()[-2:], self.rest)


def choose_items(counts: DataFrame, words: int = WORD_ITEMS, endings: int = ENDING_ITEMS) -> Items:
    end = END.decode()
    top = [end, *(r["word"] for r in counts.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(words).collect())]
    left = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in top], "word string")), "word", "left_anti")
    ends = left.groupBy(F.substring("word", -2, 2).alias("ending")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(endings).collect()
    return Items(top, [r["ending"] for r in ends])


def _coded(batches: Iterator[pa.RecordBatch], code: Callable[[bytes], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of a few texts' tokens, each text after an end token, and for each token but the first whether it follows the one before it in its text."""
    seen: dict[bytes, int] = {}
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            codes: list[int] = []
            first: list[int] = []
            for text in whole.column(0).slice(start, 500).to_pylist():
                first.append(len(codes))
                for w in (END, *tokens(text)):
                    k = seen.get(w)
                    if k is None:
                        k = seen[w] = code(w)
                    codes.append(k)
            if len(seen) > BUFFER:
                seen.clear()
            follows = np.ones(len(codes), bool)
            follows[first] = False
            yield np.asarray(codes, np.int64), follows[1:]


def _pairs(texts: DataFrame, code: Callable[[bytes], int], m: int) -> np.ndarray:
    """How often each code below m follows each, over all ``texts``; m bounds its size."""
    shared = texts.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(m * m, np.int64)
        for a, follows in _coded(batches, shared.value):
            got += np.bincount((a[:-1] * m + a[1:])[follows], minlength=m * m)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], names=["pair", "n"])

    out = np.zeros(m * m, np.int64)
    table = texts.mapInArrow(tidied(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out[table["pair"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    shared.destroy()
    return out.reshape(m, m)


def item_bigrams(texts: DataFrame, items: Items) -> np.ndarray:
    return _pairs(texts, items, items.count)


def _entropy(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def gains(pair: np.ndarray, out: np.ndarray, into: np.ndarray, own: float) -> np.ndarray:
    """What a word adds to the bigrams' log likelihood in each class. ``pair``: classes' bigrams without the word; ``out``, ``into``: classes after
    and before it, without itself; ``own``: how often it follows itself."""
    rows, cols, d, before = pair.sum(1), pair.sum(0), np.diag(pair), _entropy(pair)
    cells = (_entropy(pair + out) - before).sum(1) + (_entropy(pair + into[:, None]) - before).sum(0)
    corner = _entropy(d + out + into + own) - _entropy(d + out) - _entropy(d + into) + _entropy(d)
    # All rows get what goes into the word, its own class's row also what comes out of it; the columns likewise.
    by_row = _entropy(rows + into + out.sum() + own) - _entropy(rows + into)
    by_col = _entropy(cols + out + into.sum() + own) - _entropy(cols + out)
    return cells + corner - by_row - by_col


def exchange(bigrams: np.ndarray, classes: int = CLASSES, most: int = 12, alone: int | None = None) -> np.ndarray:
    """The class of each item. From classes dealt by frequency, each item in turn moves to the class that makes the bigrams likeliest, until none moves.
    ``alone``: an item that is class 0 by itself."""
    n = bigrams.astype(float)
    m = len(n)
    weight = n.sum(0) + n.sum(1)
    order = np.argsort(-weight, kind="stable")
    classes = max(2, min(classes, m))
    of = np.empty(m, np.int64)
    of[order] = 1 + np.arange(m) % (classes - 1) if alone is not None else np.arange(m) % classes
    if alone is not None:
        of[alone] = 0
    one = np.eye(classes)[of]
    pair = one.T @ n @ one
    for _ in range(most):
        moved = 0
        for i in order:
            if i == alone or weight[i] == 0:
                continue
            out, into, own, was = n[i] @ one, n[:, i] @ one, n[i, i], of[i]
            out[was] -= own
            into[was] -= own
            pair[was] -= out
            pair[:, was] -= into
            pair[was, was] -= own
            gain = gains(pair, out, into, own)
            if alone is not None:
                gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[was] + 1e-9:
                best = was
            pair[best] += out
            pair[:, best] += into
            pair[best, best] += own
            if best != was:
                of[i], moved = best, moved + 1
                one[i, was], one[i, best] = 0, 1
        if not moved:
            break
    return of


class Classes:
    """Which class a word is in: its own, or that of its item."""

    def __init__(self, items: Items, of: np.ndarray, own: dict[bytes, int] | None = None) -> None:
        self.items, self.of, self.own = items, of.tolist(), own or {}
        self.count = int(of.max()) + 1

    def __call__(self, word: bytes) -> int:
        k = self.own.get(word)
        return k if k is not None else self.of[self.items(word)]


def likelihood(pair: np.ndarray) -> float:
    """What of the training text's log likelihood depends on the classes, by their bigrams."""
    return float(_entropy(pair).sum() - _entropy(pair.sum(1)).sum() - _entropy(pair.sum(0)).sum())


def moved(texts: DataFrame, words: list[str], classes: Classes, pair: np.ndarray) -> dict[bytes, tuple[int, float]]:
    """For those of ``words`` that gain by another class: the class after one exchange and the gain, each by its own neighbours in all ``texts`` and with the other words' classes held."""
    context, c = texts.sparkSession.sparkContext, classes.count
    number = {w.encode(): k for k, w in enumerate(words)}
    shared, table = context.broadcast((number, classes)), context.broadcast(pair.astype(float))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = shared.value
        wide = 2 * c + 1  # classes before, classes after, and the word itself
        got = np.zeros(len(own) * wide, np.int64)
        # A code is the word's number (the last one: none of these) and its class.
        for a, follows in _coded(batches, lambda w: own.get(w, len(own)) * c + of(w)):
            word, kind = np.divmod(a, c)
            itself = word[1:] == word[:-1]
            before, after = word[1:] * wide + np.where(itself, 2 * c, kind[:-1]), word[:-1] * wide + c + kind[1:]
            keys = np.concatenate([before[follows & (word[1:] < len(own))], after[follows & ~itself & (word[:-1] < len(own))]])
            at, n = np.unique(keys, return_counts=True)
            got[at] += n
        at = np.flatnonzero(got)
        for k in range(0, len(at), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array((at[k : k + 200_000] // wide).astype(np.int32)), pa.array((at[k : k + 200_000] % wide).astype(np.int32)), pa.array(got[at[k : k + 200_000]])], names=["word", "place", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = shared.value
        names, full = list(own), table.value
        for batch in batches:
            best, more = [], []
            for k, places, ns in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                near = np.zeros(2 * c + 1)
                near[places] = ns
                into, out, self_pairs, was = near[:c], near[c : 2 * c], near[2 * c], of(names[k])
                rest = full.copy()
                rest[was] -= out
                rest[:, was] -= into
                rest[was, was] -= self_pairs
                gain = gains(rest, out, into, self_pairs)
                gain[0] = -np.inf
                best.append(int(np.argmax(gain)))
                more.append(float(gain[best[-1]] - gain[was]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(more, pa.float64())], names=["word", "class", "gain"])

    near = texts.mapInArrow(tidied(count), "word int, place int, n long").groupBy("word", "place").agg(F.sum("n").alias("n"))
    each = near.groupBy("word").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("ns"))
    chosen = each.mapInArrow(tidied(choose), "word int, class int, gain double").where("gain > 1e-9")
    out = {words[r["word"]].encode(): (r["class"], r["gain"]) for r in chosen.collect()}
    shared.destroy()
    table.destroy()
    return out


def settled(texts: DataFrame, moves: dict[bytes, tuple[int, float]], of: Classes, pair: np.ndarray) -> tuple[Classes, np.ndarray]:
    """The classes after as many of ``moves`` as together don't lower the likelihood, and their bigrams.

    Each move gains with all else held, which moves made at once don't ensure: if together they lose, only the half that gains most is made, and so on.
    """
    moves = dict(sorted(moves.items(), key=lambda x: (-x[1][1], x[0])))
    while moves:
        tried = Classes(of.items, np.asarray(of.of), {w: k for w, (k, _) in moves.items()})
        after = _pairs(texts, tried, of.count).astype(float)
        if likelihood(after) >= likelihood(pair):
            return tried, after
        moves = dict(list(moves.items())[: len(moves) // 2])
    return of, pair


class Model:
    def __init__(self, classes: Classes, bigrams: np.ndarray, held: np.ndarray, distinct: np.ndarray, head: dict[bytes, int], smoothing: float = SMOOTHING) -> None:
        prior = (bigrams.sum(0) + 1) / (bigrams.sum() + len(held))
        self.follow = np.log10((bigrams + smoothing * prior) / (bigrams.sum(1)[:, None] + smoothing))
        self.room = np.log10(held + distinct + 1.0)
        self.classes, self.head = classes, head
        self.tokens, self.distinct = int(held.sum()), int(distinct.sum())


def class_totals(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""
    shared = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        n, v = np.zeros(of.count, np.int64), np.zeros(of.count, np.int64)
        for batch in batches:
            k = np.asarray([of(w.encode()) for w in batch.column(0).to_pylist()], np.int64)
            np.add.at(n, k, batch.column(1).to_numpy())
            np.add.at(v, k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(v)], names=["class", "n", "v"])

    rows = counts.mapInArrow(tidied(run), "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(classes.count, np.int64), np.zeros(classes.count, np.int64)
    for r in rows:
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    shared.destroy()
    return n, v


def train(texts: DataFrame, head: int = HEAD, classes: int = CLASSES, vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model of the one column of ``texts``, and the counts of all words."""
    counts = stored(word_counts(texts), "word-counts")
    items = choose_items(counts)
    bigrams = item_bigrams(texts, items)
    of = Classes(items, exchange(bigrams, classes, alone=items(END)))
    top = {r["word"].encode(): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(max(head, vocabulary)).toLocalIterator()}
    one = np.eye(of.count)[of.of]
    pair = one.T @ bigrams @ one
    # The most frequent words have been exchanged among themselves; the vocabulary's others still have their endings' classes.
    movable = [w.decode() for w in list(top)[:vocabulary] if w not in items.words]
    if movable:
        of, pair = settled(texts, moved(texts, movable, of, pair), of, pair)
    held, distinct = class_totals(counts, of)
    return Model(of, pair, held, distinct, dict(list(top.items())[:head])), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score, perplexity)``; logarithms to base 10."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = shared.value, TaskContext.get().partitionId() << 32
        head, follow, room, of = m.head, m.follow, m.room, m.classes
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in slices(batches):
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = tokens(text)
                got, rare = [], Counter()
                for w in ws:
                    k = seen.get(w)
                    if k is None:
                        if len(seen) > BUFFER:
                            seen.clear()
                        k = seen[w] = head.get(w, 0), of(w)
                    got.append(k)
                    if not k[0]:
                        rare[w] += 1
                a = np.asarray(got, np.int64)
                c = a[:, 1]
                classes = float(follow[np.concatenate([[0], c[:-1]]), c].sum() - room[c].sum())
                out.append((at, key, len(ws), int((a[:, 0] > 0).sum()), float(np.log10(a[:, 0] + 1.0).sum()), classes, [w.decode() for w in rare], list(rare.values())))
                at += 1
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names=["row", "id", "n_tokens", "known", "emitted", "classes", "rare", "times"])

    local = stored(docs.select(id_col, text_col).mapInArrow(tidied(run), f"row long, id {kind}, n_tokens long, known long, emitted double, classes double, rare array<string>, times array<long>"), "lm-texts")
    rare = local.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word").select("row", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("c") + 1.0)).alias("emitted"))
    more = found.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("emitted").alias("more_emitted"))
    known, emitted = (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("known", "emitted"))
    base, scored = emitted - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.distinct + 1.0))), emitted + F.col("classes")
    return local.drop("rare", "times").join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), scored.alias("score"), F.pow(F.lit(10.0), -scored / F.col("n_tokens")).alias("perplexity"),
    )
