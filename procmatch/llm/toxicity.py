"""Toxicity by fuzzy look-up of a learnt lexicon, weighed by the words around each find.

The lexicon comes from labelled documents, ``MAX_LABELLED`` at most, chosen by hash, which bounds it: words that toxic documents hold in several different
surroundings and others hardly ever, and beginnings that several such words share. Levenshtein automata of a document's words run down a trie of the terms, so misspelled terms are
found with the edits that they need (none for words under five letters, one below nine, else two); terms below the weight ``FUZZY`` are found without edits only. A find counts less the more edits it has, and less inside a quotation of any length
or near words of reporting; a logistic curve over the sum of different terms' weights gives the score.

What a term's odds lose for each standard error is chosen from ``PENALTIES`` on ``FOLDS`` parts of the labelled sample: each part is weighed by lexicons learnt from the others, and the penalty
with the least log loss stays (of equal ones the larger); the curve is fitted to those weights. Equal texts are in one part. Surroundings are counted exactly, told apart by 64 bits of a hash.

All documents are scored whole. Null and empty texts have no finds and score as such documents do; a sample without both labels leaves
the seed terms with the prior curve; repeated rows score alike; extra columns stay or are ignored as stated.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import free_name, id_remainder, labelled_sample, slices, stored, tidied

MAX_LABELLED, THRESHOLD = 20_000, 0.7
#: Words on each side of a find that are its context, and what quotation or report there leaves of its weight.
CONTEXT, QUOTED, REPORTED, PER_EDIT = 4, 0.5, 0.7, 0.5
#: The weight (half the log odds) from which on a term is looked for with edits; a weaker one's misspelt forms are closer to innocent words than to it.
FUZZY = 2.0

#: Letters of the stems that stand for all words which begin with them.
STEMS = (6, 5, 4)
#: What the odds of a term may lose for each standard error, and the parts of the labelled sample on which that is chosen.
PENALTIES, FOLDS = (0.5, 1.0, 1.5, 2.0, 3.0), 3

# Common English insults, known before any label is seen, and words and marks of reported speech.
SEEDS = ["clown", "disgusting", "filthy", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
REPORTING = ["called", "calls", "cited", "citation", "dit", "dijo", "quote", "quoted", "quotes", "reported", "said", "says", "sagte", "term", "word", "wrote"]
QUOTES = "\"'`«»„“”‘’‹›"

_SEPARATORS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_OTHERS = re.compile(r"[^\w\x00-\x7f]+")
# An apostrophe between letters is no quotation mark.
_PIECE = re.compile(rf"[^\W_]+|(?<![^\W_])['’]|['’](?![^\W_])|[{QUOTES.translate({39: None, 8217: None})}]")
_OPENING, _CLOSING = "«„“‘‹", "»”›"


def words(text: str) -> list[bytes]:
    """Lower-case words in UTF-8, cut at all characters but letters and digits, as ``_PIECE`` does."""
    low = text.lower()
    if not low.isascii():
        low = _OTHERS.sub(" ", low)
    return low.encode().translate(_SEPARATORS).split()


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class Automaton:
    """Levenshtein automata of all words at once, for up to ``k`` edits.

    A state has, for the word's prefixes that are at most k shorter or longer than what has been read, the least edits between
    both, and k + 1 for more. What follows depends on the state and on which of the word's next letters equal
    the one read, so transitions are computed once, for whatever word.
    """

    def __init__(self, k: int) -> None:
        self.k = k
        self.start = tuple(k + 1 if o < 0 else o for o in range(-k, k + 1))
        self.known: dict[tuple[tuple[int, ...], int], tuple[int, ...] | None] = {}

    def step(self, state: tuple[int, ...], equal: int) -> tuple[int, ...] | None:
        key = state, equal
        if key not in self.known:
            new: list[int] = []
            for o, e in enumerate(state):
                least = e + (not equal >> o & 1)
                if o + 1 < len(state):
                    least = min(least, state[o + 1] + 1)
                if new:
                    least = min(least, new[-1] + 1)
                new.append(min(least, self.k + 1))
            self.known[key] = tuple(new) if min(new) <= self.k else None
        return self.known[key]


class Trie:
    """Terms, looked up by Levenshtein automata."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = sorted(set(terms))
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for t in self.terms:
            v = 0
            for c in t:
                if c not in self.children[v]:
                    self.children[v][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                v = self.children[v][c]
            self.ends[v] = t
        self.automata = {k: Automaton(k) for k in (1, 2)}
        # Of a term cut in k + 1 parts, a word within k edits has one whole: the first where it was, the last as far from the end, one between
        # them at most an edit away from its place. places: for a length of words, where to look for which parts.
        self.places: dict[int, dict[tuple[int, int], set[str]]] = {}
        for t in self.terms:
            k = edits_allowed(t)
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for n in range(len(t) - k, len(t) + k + 1) if k else ():
                for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for at in [0] if j == 0 else [n - (b - a)] if j == k else range(max(0, a - 1), a + 2):
                        self.places.setdefault(n, {}).setdefault((at, at + b - a), set()).add(t[a:b])
        self.looked = {n: list(x.items()) for n, x in self.places.items()}

    def near(self, word: str) -> bool:
        """No word within the edits allowed of a term fails this."""
        return any(word[i:j] in parts for (i, j), parts in self.looked.get(len(word), ()))

    def find(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits to the word, of those the first, if the edits are allowed for the shorter of both."""
        k = edits_allowed(word)
        if not k or not self.near(word):
            return None
        automaton, full = self.automata[k], (1 << (2 * k + 1)) - 1
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << (i + k)
        best: tuple[int, str] | None = None
        stack = [(0, 0, automaton.start)]
        while stack:
            v, d, state = stack.pop()
            if (t := self.ends[v]) is not None and abs(len(word) - d) <= k:
                edits = state[len(word) - d + k]
                if edits <= min(k, edits_allowed(t)) and (best is None or (edits, t) < best):
                    best = edits, t
            for c, to in self.children[v].items():
                if (new := automaton.step(state, places.get(c, 0) >> d & full)) is not None:
                    stack.append((to, d + 1, new))
        return (best[1], best[0]) if best else None


def enclosed(pieces: list[str]) -> list[bool]:
    """Of each piece, whether the nearest mark before it opens a quotation that one after it ends.

    Marks that look alike at both ends open if an even number of them came before.
    """
    marks, opens, seen = [], [], 0
    for i, p in enumerate(pieces):
        if p in QUOTES:
            marks.append(i)
            opens.append(p in _OPENING or p not in _CLOSING and seen % 2 == 0)
            seen = 0 if p in _CLOSING else seen + 1
    out, k = [False] * len(pieces), 0
    for i in range(len(pieces)):
        while k < len(marks) and marks[k] < i:
            k += 1
        if 0 < k < len(marks) and marks[k] != i:
            out[i] = opens[k - 1]
    return out


class _Known(dict):
    """What each word (UTF-8) stands for: (term, edits), or None."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: bytes) -> tuple[str, int] | None:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = self.model.look_up(word.decode())
        return found


class Model:
    def __init__(self, weights: dict[str, float], innocent: set[str], curve: tuple[float, float]) -> None:
        self.weights, self.innocent, self.curve = weights, innocent, curve
        self.trie = Trie([w for w, v in weights.items() if v >= FUZZY and w[-1] != "*"])
        self.known = _Known(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known = _Known(self)

    def look_up(self, word: str) -> tuple[str, int] | None:
        if word in self.weights:
            return word, 0
        if word in self.innocent or len(word) < 4:
            return None
        for n in STEMS:
            if len(word) > n and (stem := word[:n] + "*") in self.weights:
                return stem, 0
        return self.trie.find(word)

    def finds(self, text: str | None) -> list[tuple[str, int, float]]:
        """(term, edits, share of its weight that its context leaves) of each find."""
        names = {w.decode(): f for w in set(words(text or "")) if (f := self.known[w])}
        if not names:
            return []
        pieces, out = _PIECE.findall(text.lower()), []
        quoted = enclosed(pieces)
        for i, p in enumerate(pieces):
            if f := names.get(p):
                left = QUOTED if quoted[i] else 1.0
                if any(x in _REPORTING for x in pieces[max(0, i - CONTEXT) : i]):
                    left *= REPORTED
                out.append((*f, left))
        return out

    def evidence(self, text: str | None) -> float:
        """Weights of the different terms found, each as its best find has it."""
        best: dict[str, float] = {}
        for term, edits, left in self.finds(text):
            best[term] = max(best.get(term, 0.0), self.weights[term] * left * PER_EDIT**edits)
        return sum(best.values())

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * self.evidence(text)))))


_REPORTING = frozenset(REPORTING)
#: The curve's prior: one certain term is toxic.
PRIOR = (-3.0, 1.4)


def fit_curve(evidence: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, held near the prior as by a few documents."""
    x, y = np.column_stack([np.ones(len(evidence)), np.minimum(evidence, 20)]), labels
    w, prior = np.array(PRIOR), np.array(PRIOR)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + (w - prior))
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.1))


def log_loss(curve: tuple[float, float], evidence: np.ndarray, labels: np.ndarray) -> float:
    z = np.clip(curve[0] + curve[1] * evidence, -30, 30) * np.where(labels > 0, 1, -1)
    return float(np.log1p(np.exp(-z)).mean())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_LABELLED) -> Model:
    sample = labelled_sample(labels, label, bound)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")

    texts = texts.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[tuple[str, int, int, str], None] = {}
            for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                ws = [w.decode() for w in words(text)]
                for a, w, b in zip(["", *ws], ws, [*ws[1:], ""], strict=False):
                    rows[w, y, fold, f"{a} {b}"] = None
            types = pa.string(), pa.int32(), pa.int32(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows, strict=True)) or [()] * 4, types, strict=True)], names=["word", "label", "fold", "around"])

    # Copies repeat a word in the same surroundings, so different ones are counted, not documents; for each part also those outside it.
    around = texts.mapInArrow(tidied(run), "word string, label int, fold int, around string")
    marks = around.groupBy("word", "label", F.xxhash64("around").alias("around")).agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
    outside = lambda f: F.lit(True) if f < 0 else (F.col("low") != f) | (F.col("high") != f)
    parts = range(-1, FOLDS)  # -1: nothing left out
    seen = stored(marks.groupBy("word").agg(*[F.count_if((F.col("label") == y) & outside(f)).alias(f"n{y}_{f + 1}") for f in parts for y in (0, 1)]), "toxic-words")
    sizes = {(r["label"], r["fold"]): r["n"] for r in texts.groupBy("label", "fold").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    left = {(y, f): sum(n for (label, fold), n in sizes.items() if label == y and fold != f) for f in parts for y in (0, 1)}
    if not (left[0, -1] and left[1, -1]):
        return Model({w: 2.0 for w in SEEDS}, set(), PRIOR)
    able = [f for f in parts if left[0, f] and left[1, f]]

    # Few surroundings say little: the odds count less by their standard error, about one over the root of the number.
    def odds(f: int) -> Column:
        n0, n1 = F.col(f"n0_{f + 1}"), F.col(f"n1_{f + 1}")
        return F.log((n1 + 0.5) / (left[1, f] + 1)) - F.log((n0 + 0.5) / (left[0, f] + 1))

    def candidates(rows: DataFrame, name: str, allowed: Callable[[int], Column], least: float) -> list[tuple[str, int, float, float]]:
        """(term, part, odds, standard error) of all that the smallest penalty leaves above ``least``."""
        at = F.explode(F.array_compact(F.array(*[F.when(allowed(f), F.struct(F.lit(f).alias("f"), odds(f).alias("odds"), F.pow(f"n1_{f + 1}", F.lit(-0.5)).alias("error"))) for f in able])))
        got = rows.select(F.col(name).alias("term"), at.alias("at")).where(F.col("at.odds") - min(PENALTIES) * F.col("at.error") > least)
        return [tuple(r) for r in got.select("term", "at.*").collect()]

    terms = candidates(seen.where(F.length("word") >= 3), "word", lambda f: F.col(f"n1_{f + 1}") >= 2, 2.5)
    # Word formation: beginnings that many different words of toxic documents have, and hardly any others.
    cut = F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS])
    counts = [f"n{y}_{f + 1}" for f in parts for y in (0, 1)]
    forms = [F.count_if(F.col(f"n1_{f + 1}") > F.col(f"n0_{f + 1}")).alias(f"forms_{f + 1}") for f in parts]
    stems = seen.select(F.explode(F.array_compact(cut)).alias("stem"), *counts).groupBy("stem").agg(*[F.sum(c).alias(c) for c in counts], *forms)
    stems = candidates(stems, "stem", lambda f: (F.col(f"n1_{f + 1}") >= 4) & (F.col(f"forms_{f + 1}") >= 3), 3.0)

    def lexicon(f: int, penalty: float) -> dict[str, float]:
        out = {w: 2.0 for w in SEEDS}
        for found, least, end in ((terms, 2.5, ""), (stems, 3.0, "*")):
            out |= {t + end: min(4.0, (o - penalty * e) / 2) for t, g, o, e in found if g == f and o - penalty * e > least}
        return out

    # Known misspellings' opposite: words near a term of any lexicon, or terms, that documents without toxicity hold as often.
    widest: dict[str, float] = {}
    for f in able:
        for t, v in lexicon(f, min(PENALTIES)).items():
            widest[t] = max(v, widest.get(t, v))
    draft = docs.sparkSession.sparkContext.broadcast(Model(widest, set(), PRIOR))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = pa.array([w not in draft.value.weights and len(w) > 3 and draft.value.trie.find(w) is not None for w in batch.column(0).to_pylist()], pa.bool_())
            yield batch.filter(ok)

    common = lambda f: (F.col(f"n0_{f + 1}") >= 1) & (F.col(f"n0_{f + 1}") >= F.col(f"n1_{f + 1}"))
    flags = seen.select("word", F.array_compact(F.array(*[F.when(common(f), F.lit(f)) for f in able])).alias("parts")).where(F.size("parts") > 0)
    innocent = [(r["word"], set(r["parts"])) for r in flags.mapInArrow(tidied(near), "word string, parts array<int>").collect()]
    draft.destroy()

    def built(f: int, penalty: float, curve: tuple[float, float] = PRIOR) -> Model:
        # A part whose rest lacks a label is weighed by the seed terms.
        return Model(lexicon(f, penalty), {w for w, at in innocent if f in at}, curve)

    models = docs.sparkSession.sparkContext.broadcast([[built(f, p) for p in PENALTIES] for f in range(FOLDS)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [[m.evidence(t) for m in models.value[f]] for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column("label")], names=["evidence", "label"])
        for m in (m for f in models.value for m in f):
            m.known.clear()

    rows = texts.mapInArrow(tidied(weigh), "evidence array<double>, label int").toPandas()
    models.destroy()
    evidence, y = np.stack(rows["evidence"]), rows["label"].to_numpy(float)
    # In a defined order, so that sums don't depend on that of the rows.
    order = np.lexsort((*evidence.T, y))
    curves = [fit_curve(e, y[order]) for e in evidence[order].T]
    losses = [log_loss(c, e, y[order]) for c, e in zip(curves, evidence[order].T, strict=True)]
    best = min(range(len(PENALTIES)), key=lambda k: (round(losses[k], 9), -PENALTIES[k]))
    return built(-1, PENALTIES[best], curves[best])


def add_score(docs: DataFrame, model: Model, name: str = "toxicity", text_col: str = "text") -> DataFrame:
    """``docs`` with a score in one more column."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = pa.array([shared.value.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])
        shared.value.known.clear()  # the worker lives on

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""
    scored = add_score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    name = free_name("toxicity", docs.columns)
    return add_score(docs, model, name).where(F.col(name) < threshold).drop(name)
