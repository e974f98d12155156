"""Best-fit packing, with bounds that certify the number of sequences.

``tokenize`` cuts documents into pieces of at most ``capacity`` tokens. ``pack`` deals the pieces to groups of
bounded size; each group runs best-fit decreasing and compares its number of bins with lower bounds from
dual-feasible functions. Bins with much room, and all of groups above their bound, are exchanged whole between groups
and packed again; a group keeps its former bins unless the new ones are fewer. This ends when the number of all bins equals the
bound of all pieces, or when an exchange saves no bin. ``group_bins`` and ``group_bound`` are each piece's certificate: the bins of the group that it was last
packed in, and the least that this group's pieces need.

Defined cases: null and empty texts are one piece holding the end token; repeated rows are packed each by itself; a
null id stays null; a text of any length is tokenized whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import slices, stored, tidied

CAPACITY = 1024
#: Pieces that one group packs at once.
GROUP = 50_000
#: Bytes of chunks and ids that a worker remembers within a task; beyond that it starts anew, which costs time but changes nothing.
REMEMBERED = 48 << 20
#: New chunks that are tokenized at once.
TOGETHER = 20_000


#: How byte-level pre-tokenizers cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a file's merges are tried on, before the faster library takes them over.
PROBE = "Hello, world! It's 12,345 o'clock; naïve café, über-große Straßenkreuzung, año nuevo…\n\t x==y  {z}\r\n日本語テキスト 😀😀 1e-9 don't WE'LL unbelievable internationalisation qwzrtplk ÉÀÜ ́"


class Encoder:
    """Ids of texts by a tokenizers file with a byte-level pre-tokenizer, as little-endian unsigned 32-bit bytes.

    No token of such a tokenizer spans a single space between two characters that are no white space, and that space belongs to what follows it. So a text's
    ids are those of its chunks, cut before such spaces, and most chunks have been seen before. New ones are tokenized
    together, a line break between two, and cut apart by the tokens' bytes; those that begin or end with more white space, hold a special token or can't be cut
    apart, are tokenized by themselves. Where ids are ranks of merges, which is tried on a probe, tiktoken merges by the file's vocabulary; it gives the same ids sooner.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        every = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(every.values()) + 1, np.int64)
        for token, i in every.items():
            self.bytes_of[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.size = 0
        # Cutting at spaces rests on a byte-level pre-tokenizer by pattern, without any normalizer; others get whole texts.
        before = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.cuts = self.tokenizer.normalizer is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.together = self._tokenizers
        ranks = self._ranks({t: i for t, i in vocabulary.items() if t not in self.special})
        if ranks:
            import tiktoken

            encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            if all(encode(PROBE[i:]) == self._tokenizers(PROBE[i:]) for i in range(len(PROBE))):
                self.together = encode

    def _tokenizers(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int] | None:
        """The vocabulary's tokens as bytes: printable bytes stand for themselves, the others for characters from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        try:
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
        except KeyError:
            return None
        return ranks if all(bytes([b]) in ranks for b in range(256)) and len(ranks) == len(set(ranks.values())) == len(vocabulary) else None

    def alone(self, text: str) -> bytes:
        return np.asarray(self._tokenizers(text), "<u4").tobytes()

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's chunks; those but the first without the space that they begin with. The first has a line break before it, as no other chunk has."""
        first, *parts = text.split(" ")
        if not _ADJACENT.search(text):
            return ["\n" + first, *parts]
        out = ["\n" + first]
        for p in parts:
            if p and not p[0].isspace() and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def forget(self) -> None:
        self.seen, self.size = {}, 0

    def learn(self, new: list[str]) -> None:
        names, texts = [], []
        for c in new:
            text = c[1:] if c[0] == "\n" else " " + c
            if not text or text[-1].isspace() or text[0].isspace() and (len(text) == 1 or text[0] != " " or text[1].isspace()) or any(s in text for s in self.special):
                self.seen[c] = self.alone(text) if text else b""
            else:
                names.append(c)
                texts.append(text)
        for at in range(0, len(names), TOGETHER):
            own, part = names[at : at + TOGETHER], texts[at : at + TOGETHER]
            ids = np.asarray(self.together("\n".join(part)), "<u4")
            ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            stops = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1) - 1
            starts = np.concatenate([[0], stops[:-1] + 1])
            i, j = np.searchsorted(ends, starts), np.searchsorted(ends, stops)
            raw = ids.tobytes()
            self.seen.update(zip(own, [raw[a:b] for a, b in zip((4 * i).tolist(), (4 * j).tolist(), strict=True)], strict=True))
            for k in np.flatnonzero((ends[np.minimum(i, len(ids))] != starts) | (ends[np.minimum(j, len(ids))] != stops)).tolist():
                self.seen[own[k]] = self.alone(part[k])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return [self.alone(t) if t else b"" for t in texts]
        cut = [self.chunks(t) if t else [] for t in texts]
        if self.size > REMEMBERED:
            self.forget()
        if new := set().union(*cut).difference(self.seen):
            self.learn(list(new))
            # A string, its ids' bytes and their place in the table take some 200 bytes besides their contents.
            self.size += sum(200 + 2 * len(c) + len(self.seen[c]) for c in new)
        get = self.seen.__getitem__
        return [b"".join(map(get, c)) for c in cut]


_ADJACENT = re.compile(r"\s\s|^\s|\s$")
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full, but for the first one."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces ``(row, doc_id, piece, start, length, ids_crc32[, ids])``; ``row`` numbers them uniquely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, at = _encoder(path), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, (s, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    out.append((at, key, k, s, n, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype("i4")] if with_ids else [])))
                    at += 1
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names=names)
        _encoders.clear()  # the worker lives on, for tasks of other kinds too

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds. Items from long to short, each to the bin that it fills most."""
    place, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return place, offset, np.asarray(fill, np.int64)


def lower_bound(counts: np.ndarray) -> int:
    """No packing has fewer bins. counts[n]: items of length n, up to the capacity; the best of two families of dual-feasible functions.

    The first, for each e up to half the capacity, takes lengths above capacity - e as full and those below e as nothing. The second,
    for each k, rounds a length's share of the capacity down to k-ths of bins that hold k + 1 items at most.
    """
    c = len(counts) - 1
    x = np.arange(c + 1)
    total, number = np.cumsum(counts * x), np.cumsum(counts)
    e = np.arange(1, c // 2 + 1)
    best = max(total[c], int((c * (number[c] - number[c - e]) + total[c - e] - total[e - 1]).max(initial=0)))
    bins = math.ceil(best / c)
    for k in range(1, 21):
        scaled = (k + 1) * x
        bins = max(bins, math.ceil(int((counts * np.where(scaled % c == 0, k * x, scaled // c * c)).sum()) / (k * c)))
    return bins


def _repack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One group: packed, or left as it was if that has no more bins; with its number of bins and the least that is possible."""
    pdf = pdf.sort_values("row", ignore_index=True)
    n, former = pdf["length"].to_numpy(), pdf["sequence_id"].to_numpy()
    before = len(np.unique(former)) if (former >= 0).all() else len(n) + 1
    least = lower_bound(np.bincount(n, minlength=capacity + 1))
    if before > least:
        place, offset, fill = best_fit_decreasing(n, capacity)
        if len(fill) < before:
            first = np.full(len(fill), -1, np.int64)
            at = offset == 0
            first[place[at]] = pdf["row"].to_numpy()[at]
            pdf["sequence_id"], pdf["offset"], pdf["room"] = first[place], offset, capacity - fill[place]
            before = len(fill)
    pdf["group_bins"], pdf["group_bound"] = before, least
    return pdf


def bound_of(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The least number of bins for all pieces, from the counts of their lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound(counts)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (stored, with ``row`` and ``length``) with ``sequence_id``, ``offset``, ``group_bins`` and ``group_bound``. A sequence has the ``row`` of its first piece as its id."""
    long = lambda x: F.lit(x).cast("long")
    done = [pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("row"), "offset": long(0), "group_bins": long(1), "group_bound": long(1)})]
    names = done[0].columns
    todo = pieces.where(F.col("length") < capacity).withColumns({"sequence_id": long(-1), "offset": long(0), "group_bins": long(0), "group_bound": long(0), "room": long(capacity)})
    least = bound_of(todo, capacity)
    settled = was = 0
    for r in itertools.count():
        left = todo.count()
        if not left:
            return _union(done)
        parts = math.ceil(left / group)
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("sequence_id" if r else "row", F.lit(r)), F.lit(parts))).repartition(parts, "part")
        packed = stored(dealt.groupBy("part").applyInPandas(lambda pdf: _repack(pdf, capacity), dealt.schema).drop("part"), "packed")
        bins = packed.where("offset = 0").count()
        # One group that was packed whole can't do better by itself; nor need others, when all is proven or the last exchange saved nothing.
        if parts == 1 or settled + bins <= least or (r and bins >= was):
            return _union([*done, packed.select(names)])
        again = (F.col("group_bins") > F.col("group_bound")) | (F.col("room") >= capacity // 16)
        done.append(packed.where(~again).select(names))
        todo = packed.where(again)
        was = todo.where("offset = 0").count()
        settled += bins - was


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``tokenize``, then ``pack``: a row per piece with its place in a sequence."""
    return pack(stored(tokenize(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, of pieces packed ``with_ids``; a group holds ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
