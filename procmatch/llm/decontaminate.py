"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton is built on the driver for at most ``BLOCK_WORDS`` words of items and broadcast; more items make more
blocks, and the documents stream through one block after the other, with what was found so far stored in between, so that driver and workers hold one block
at a time. Each document is read once a block, word by word:
the automaton's state gives the longest match that ends there, and its marks give the items that it occurs in.

Defined cases: null texts and texts without words have no hits; items without words count for nothing; equal items count
each; documents of any length are read whole; repeated rows are judged each; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import free_name, slices, stored, tidied

WINDOW = 10
BLOCK_WORDS = 200_000

#: UTF-8 bytes: A-Z to a-z, separators to a space, byte for byte.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


_NONE: frozenset[int] = frozenset()


class SuffixAutomaton:
    """Of several word sequences; its states carry the items whose windows they stand for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        for ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, ws in enumerate(coded):
            v = 0
            for w in ws:
                v = self.next[v][w]
                u = v
                while u > 0 and self.length[u] >= window and k not in self.items[u]:
                    self.items[u].add(k)
                    u = self.link[u]
            if 0 < len(ws) < window:
                self.short.setdefault(v, []).append((len(ws), k))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.has_short = bytearray(len(self.next))
        self.at_window = array("i", range(len(self.next)))  # where a match of at least a window, cut to a window, stands
        for v in order:
            u = self.link[v]
            self.has_short[v] = v in self.short or self.has_short[u]
            if u > 0 and self.length[u] >= window:
                self.at_window[v] = self.at_window[u]
        self._flatten()

    def _flatten(self) -> None:
        """Most states have one way on, kept in two arrays; a dictionary holds the ways of the others only, and sets those of states that stand for items."""
        self.items = {v: frozenset(x) for v, x in enumerate(self.items) if x}
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.only, self.to = (array("i", [next(iter(f(x)), -1) if len(x) == 1 else -1 for x in self.next]) for f in (dict.keys, dict.values))
        self.next = {v: x for v, x in enumerate(self.next) if len(x) > 1}

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the strings of p followed by w, apart from longer ones of q."""
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans [from, to) of hit words in order, and the items found."""
        code, several, only, target, link, length, window = self.vocabulary.get, self.next, self.only, self.to, self.link, self.length, self.window
        v = n = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, word in enumerate(ws):
            w = code(word)
            if w is None:
                v = n = 0
                continue
            while True:
                to = target[v] if only[v] == w else several[v].get(w, -1) if v in several else -1
                if to >= 0 or not v:
                    break
                v = link[v]
                n = length[v]
            if to < 0:
                continue
            v, n = to, n + 1
            if n >= window:
                found |= self.items.get(self.at_window[v], _NONE)
                spans.append((i - window + 1, i + 1))
            if self.has_short[v]:
                u = v
                while u > 0:
                    for m, k in self.short.get(u, ()):
                        if m <= n:
                            found.add(k)
                            spans.append((i - m + 1, i + 1))
                    u = link[u]
        return merged(spans), {self.names[k] for k in found}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (name, words) in blocks, each collected only after its size is known. An item of more words than a block is a block's only one, if the hash has it so."""
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("item_text"))
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    count = max(1, -(-size // 2 // block_words))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k).collect()
        yield sorted((r["item"], words(r["item_text"])) for r in rows)


SPANS, FOUND = "array<struct<from: int, to: int>>", "array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_words: int = BLOCK_WORDS, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """``docs`` with three more columns under ``names``: the number of words, hit spans (word positions [from, to)) and items (sorted as strings)."""
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"choose other names than {names}: the documents have such columns")
    return _matched(docs, benchmark, window, text_col, block_words, names)


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, block_words: int, names: tuple[str, str, str], finish: Callable[[pa.RecordBatch, list, list], pa.RecordBatch] | None = None) -> DataFrame:
    """``find_contamination``; or, with ``finish``, what it makes of the batches of documents and their words' numbers and hit spans, in the tasks that read the last block."""
    at, width = docs.columns.index(text_col), len(docs.columns)
    none = F.expr(f"cast(array() as {SPANS})"), F.expr(f"cast(array() as {FOUND})")
    out = docs.withColumns(dict(zip(names, (F.lit(0).cast("long"), *none), strict=True)))
    former, todo = None, blocks(benchmark, block_words)
    block = next(todo)
    while block is not None:
        following = next(todo, None)
        last = following is None and finish is not None
        if former is not None:
            out = stored(out, "contamination")
            former.destroy()
        shared = former = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in slices(batches):
                n, spans, items = [], [], []
                for text, was, had in zip(batch.column(at).to_pylist(), batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True):
                    ws = words(text)
                    s, i = own.hits(ws)
                    n.append(len(ws))
                    spans.append([{"from": a, "to": b} for a, b in merged([*s, *((x["from"], x["to"]) for x in was)])])
                    items.append(sorted(i.union(had)))
                if last:
                    yield finish(batch.select(list(range(width))), n, spans)
                    continue
                new = [pa.array(v, batch.schema.field(width + k).type) for k, v in enumerate((n, spans, items))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], schema=batch.schema)

        out = out.mapInArrow(tidied(run), docs.schema if last else out.schema)
        block = following
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: how much of it is hit, and by which items."""
    found = find_contamination(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")), benchmark, window, "body")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORDS))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = WINDOW - 1, max_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without benchmark text: documents with more than ``max_coverage`` of their words hit go, and of the others the
    hit spans of over ``max_span`` words, and all of those that a whole short item makes."""
    at = docs.columns.index(text_col)

    def cut(batch: pa.RecordBatch, n_words: list[int], spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
        hit = [sum(x["to"] - x["from"] for x in s) for s in spans]
        kept = pa.array([not n or h <= n * max_coverage for n, h in zip(n_words, hit, strict=True)])
        texts = [t if not s else without_spans(t, [(x["from"], x["to"]) for x in s if x["to"] - x["from"] > max_span or x["to"] - x["from"] < window]) for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
        new = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(new, schema=batch.schema).filter(kept)

    return _matched(docs, benchmark, window, text_col, BLOCK_WORDS, tuple(free_name(n, docs.columns) for n in ("n_words", "hit_spans", "hit_items")), cut)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
