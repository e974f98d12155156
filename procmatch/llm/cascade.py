"""Quality rules as a short-circuit cascade: what each rule costs and rejects is measured on a sample, and the rule that rejects most for its cost comes first.

Measures that every document needs are taken of its whole text; who fails the base rules meets no other rule. All others go
through the rules in order until one rejects them. The order is greedy: after each choice, rejections and costs are taken over
those sampled documents that are left, so rules that reject the same documents don't count twice. The order decides how much work is done, never
who is kept: that is whether any rule rejects. The sample is of bounded size, whatever the table's.

Null and empty texts have no words and fail the base rules; repeated rows and null ids are rows like others. Other columns stay out of the
result, so their names can't clash. An empty table gives no rows and the rules in the order given.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import slices, tidied

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Base rules: words at least; words in repeated windows of WINDOW words, percent of all words at most.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Documents, more or less, whose costs and rejections are measured.
SAMPLE = 2000

_UPPER, _LOWER, _LETTER = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]")
_STRIP_SYMBOLS = str.maketrans("", "", SYMBOLS)


class Page:
    """A text with what rules ask of it; each is worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(_STRIP_SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier one."""
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        """A number for each word, equal for equal words, from 0 on."""
        known: dict[str, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)

    def grams(self, n: int) -> np.ndarray:
        """A number for each window of ``n`` words, equal for equal windows."""
        if self.n_words < n:
            return np.empty(0, np.int64)
        size, code = int(self.ids.max()) + 1, self.ids[: self.n_words - n + 1]
        high = size
        for k in range(1, n):
            if high > (1 << 62) // size:
                _, code = np.unique(code, return_inverse=True)
                high = len(code)
            code, high = code * size + self.ids[k : self.n_words - n + 1 + k], high * size
        return code

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three that the text holds twice or more, the first of them too."""
        code = self.grams(WINDOW)
        if not len(code):
            return 0
        _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
        twice, hit = counts[at] > 1, np.zeros(self.n_words, bool)
        for k in range(WINDOW):
            hit[k : k + len(code)] |= twice
        return int(hit.sum())

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` sees pages that passed the base rules, so there are words."""

    name: str
    rejects: Callable[[Page], bool]


def _shouted(word: str) -> bool:
    return len(_UPPER.findall(word)) > 1 and not _LOWER.search(word)


def _top_pair(page: Page) -> bool:
    code, words = page.grams(2), page.words
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    k = counts.argmax()
    # Among equally frequent pairs any may stand for all: the longest does.
    long = max((len(words[f]) + len(words[f + 1]) for f in first[counts == counts[k]]))
    return counts[k] > 1 and 5 * int(counts[k]) * long > page.word_chars


#: After the published rules for web text (Gopher, C4, RefinedWeb), in no special order. Where shares of duplicate lines are
#: published at 0.3, 0.5 is taken: a license line in a text of few lines is no fault.
RULES = [
    Rule("mean_word_length", lambda p: not 3 * p.n_words <= p.word_chars <= 10 * p.n_words),
    Rule("symbols", lambda p: 10 * p.n_symbols > p.n_words),
    Rule("few_letters", lambda p: 5 * sum(1 for w in p.words if _LETTER.search(w)) < 4 * p.n_words),
    Rule("shouting", lambda p: 10 * sum(map(_shouted, p.words)) > 3 * p.n_words),
    Rule("exclamations", lambda p: 10 * p.text.count("!") > p.n_words),
    Rule("duplicate_lines", lambda p: 2 * p.n_dup_lines > len(p.lines)),
    Rule("bullets", lambda p: 10 * sum(1 for x in p.lines if x.lstrip(" \t").startswith(("-", "*", "•"))) > 9 * len(p.lines)),
    Rule("ellipses", lambda p: 10 * sum(1 for x in p.lines if x.rstrip(" \t\r").endswith(("...", "…"))) > 3 * len(p.lines)),
    Rule("top_pair", _top_pair),
    Rule("few_different_words", lambda p: len(set(p.words)) < 0.1 * p.n_words),
]


def sampled(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(costs, rejects)``: nanoseconds and verdict of each rule for some ``sample`` documents that pass the base rules, chosen by hash."""
    share = sample / max(1, docs.count())
    chosen = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < share * 1_000_000).limit(4 * sample)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            costs, verdicts = [], []
            for t in batch.column(0):
                page = Page(t.as_py())
                if page.base_failed:
                    continue
                page.n_symbols, page.word_chars, page.n_dup_lines  # noqa: B018  every document has these, so no rule pays for them
                took, said = [], []
                for rule in rules:
                    began = time.perf_counter_ns()
                    said.append(bool(rule.rejects(page)))
                    took.append(time.perf_counter_ns() - began)
                costs.append(took)
                verdicts.append(said)
            yield pa.RecordBatch.from_arrays([pa.array(costs, pa.list_(pa.int64())), pa.array(verdicts, pa.list_(pa.bool_()))], names=["costs", "rejects"])

    return chosen.mapInArrow(run, "costs array<long>, rejects array<boolean>")


def ordered(costs: np.ndarray, rejects: np.ndarray) -> list[int]:
    """The places of rules, by rejections for their cost among the documents that no earlier rule rejects; ties by place."""
    left, rest, out = np.ones(len(costs), bool), list(range(costs.shape[1])), []
    while rest:
        paid = [rejects[left, r].sum() / max(1, costs[left, r].sum()) for r in rest]
        # Rules that reject nothing more come last, cheap ones first.
        best = min(range(len(rest)), key=lambda i: (-paid[i], costs[:, rest[i]].sum() if not paid[i] else 0, rest[i]))
        out.append(rest.pop(best))
        left &= ~rejects[:, out[-1]]
    return out


def plan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """``rules`` in the order in which they are to run on ``docs``."""
    rows = sampled(docs, rules, text, sample).collect()
    if not rows:
        return list(rules)
    return [rules[i] for i in ordered(np.array([r["costs"] for r in rows], float), np.array([r["rejects"] for r in rows], bool))]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, rules: list[Rule] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by, n_rules)`` of each row.

    ``rules`` in their order; None: ``plan`` orders ``RULES``. ``rejected_by``: the first rule that rejects, "base", or null, which depends on the order;
    ``n_rules``: how many were asked.
    """
    rules = plan(docs, text=text) if rules is None else rules
    kind = docs.schema[doc].dataType

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, failed, kept, by, asked = [], [], [], [], []
            for t in batch.column(1):
                page = Page(t.as_py())
                counts.append([getattr(page, m) for m in MEASURES])
                why, n = "base" if page.base_failed else None, 0
                if why is None:
                    for n, rule in enumerate(rules, 1):
                        if rule.rejects(page):
                            why = rule.name
                            break
                failed.append(why == "base")
                kept.append(why is None)
                by.append(why)
                asked.append(n)
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(by, pa.string()), pa.array(asked, pa.int32())], names=["id", *MEASURES, "base_failed", "kept", "rejected_by", "n_rules"])

    measured = docs.select(F.col(doc).alias("id"), F.col(text)).mapInArrow(run, f"id {kind.simpleString()}, {', '.join(f'{m} long' for m in MEASURES)}, base_failed boolean, kept boolean, rejected_by string, n_rules int")
    return measured.withColumnRenamed("id", doc) if doc != "id" else measured


def profile(verdicts: DataFrame) -> DataFrame:
    """``(rejected_by, n, n_rules)``: rejections of each rule and the rules that were asked, over the whole table."""
    return verdicts.groupBy("rejected_by").agg(F.count("*").alias("n"), F.sum("n_rules").alias("n_rules"))
