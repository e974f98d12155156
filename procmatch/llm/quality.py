"""Quality by a vote of the nearest labelled documents in a latent-semantic space.

A document's terms are its words in lower case, the shapes of its words (letters of one case in a row are one sign; other characters stay) and how
often words repeat the one before, words occurred before, and lines occurred before. Shapes and repetition are hashed to ``SHAPES`` counts; words go through a
random projection of bounded size, each with a sign drawn by hash to one of ``WORDS`` sums. Terms are weighted by the labelled documents' idf, words also by one of ``WORD_WEIGHTS``, and
projected on their ``RANK`` largest singular vectors. The labelled vectors, ``MAX_LABELLED`` at most, are
broadcast, and every document is compared with all of them, a block of documents at a time, by one matrix product. The ``NEIGHBOURS`` most similar ones
vote with their similarity to the power ``POWER``. The words' weight is the one with the least log loss when each labelled document is left out and judged by the others (of equal ones the smaller).

The labelled sample (bounded, chosen by hash) fits the space and votes; all else covers every document whole. Null and empty
texts, and all if nothing is labelled, score the share of label 1 (0.5 without labels); repeated rows score alike; of rows that share
a labelled id the smallest text votes; similarities equal to six decimals are ties, which go to the earlier of the labelled rows in the order of their ids' crc32; ids are of any type; extra columns are ignored.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import id_remainder, labelled_sample, slices, tidied

MAX_LABELLED, RANK, NEIGHBOURS, POWER = 4000, 64, 25, 8
SHAPES, WORDS, WORD_WEIGHTS = 512, 512, (0.25, 0.5, 1.0)
TERMS = SHAPES + WORDS

_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"a+|A+|0+")
_slots: dict[bytes, int] = {}


def _slot(term: bytes) -> int:
    k = _slots.get(term)
    if k is None:
        if len(_slots) > 100_000:
            _slots.clear()
        k = _slots[term] = zlib.crc32(term) % SHAPES
    return k


def term_shares(text: str | None) -> dict[int, float]:
    """Hashed terms of a text, as the square roots of their shares; words with their signs."""
    if not text:
        return {}
    raw = text.encode()
    words = raw.split()
    if not words:
        return {}
    got = Counter(_RUN.sub(lambda m: m[0][:1], raw.translate(_SHAPE)).split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    got[b" again"] = sum(map(operator.eq, words, words[1:]))
    got[b" seen"] = len(words) - len(set(words))
    got[b" line"] = round(len(words) * (1 - len(set(lines)) / max(1, len(lines))))
    out: dict[int, float] = {}
    for term, n in got.items():
        k = _slot(term)
        out[k] = out.get(k, 0.0) + n / len(words)
    out = {k: v**0.5 for k, v in out.items() if v > 0}
    for word, n in Counter(text.lower().encode().split()).items():
        h = zlib.crc32(word)
        k = SHAPES + h % WORDS
        out[k] = out.get(k, 0.0) + (1 if h >> 20 & 1 else -1) * (n / len(words)) ** 0.5
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, t in enumerate(texts):
        if got := term_shares(t):
            out[i, list(got)] = list(got.values())
    return out


class Voters:
    """Labelled vectors and the space they lie in. Rows come in the order that ties follow."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float64)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.idf = np.log((len(terms) + 1) / ((terms != 0).sum(0) + 1)).astype(np.float32) + 1
        fits = []
        for weight in WORD_WEIGHTS:
            scale = self.idf * np.where(np.arange(TERMS) < SHAPES, 1, weight).astype(np.float32)
            gram = (terms * scale).T.astype(np.float64) @ (terms * scale)
            self.basis = scale[:, None] * np.linalg.eigh(gram)[1][:, ::-1][:, :RANK].astype(np.float32)
            self.vectors = self.project(terms)
            p = np.clip(self.vote(terms, own=True), 1e-6, 1 - 1e-6)
            loss = -np.log(np.where(self.labels > 0, p, 1 - p)).mean() if len(labels) else 0.0
            fits.append((round(float(loss), 9), weight, self.basis, self.vectors))
        _, self.weight, self.basis, self.vectors = min(fits, key=lambda f: f[:2])

    def project(self, terms: np.ndarray) -> np.ndarray:
        v = terms @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def vote(self, terms: np.ndarray, block: int = 512, own: bool = False) -> np.ndarray:
        """``own``: the rows are the labelled ones, and none votes for itself."""
        if len(self.labels) <= own:
            return np.full(len(terms), self.prior)
        out, k = np.empty(len(terms)), min(NEIGHBOURS, len(self.labels) - own)
        for a in range(0, len(terms), block):
            near = np.round(self.project(terms[a : a + block]) @ self.vectors.T, 6)
            if own:
                at = np.arange(len(near))
                near[at, a + at] = -2
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            above, equal = near > least, near == least
            top = np.nonzero(above | equal & (equal.cumsum(1) <= k - above.sum(1, keepdims=True)))[1].reshape(len(near), k)
            weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** POWER
            out[a : a + block] = ((weight * self.labels[top]).sum(1) + 1e-3 * self.prior) / (weight.sum(1) + 1e-3)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_LABELLED) -> Voters:
    sample = labelled_sample(labels, label, bound)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = texts.select(F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("place"), F.col("doc_id").cast("string").alias("id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [term_shares(t) for t in batch.column("text").to_pylist()]
            at = pa.array([list(g) for g in got], pa.list_(pa.int32()))
            share = pa.array([list(g.values()) for g in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("id"), batch.column("label"), at, share], names=["place", "id", "label", "at", "share"])

    terms = texts.mapInArrow(tidied(run), "place long, id string, label int, at array<int>, share array<double>")
    rows = sorted(terms.toLocalIterator(), key=lambda r: (r["place"], r["id"]))
    m = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        m[i, r["at"]] = r["share"]
    return Voters(m, np.asarray([r["label"] for r in rows]))


def score(docs: DataFrame, voters: Voters, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.vote(matrix(batch.column(1).to_pylist())))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
