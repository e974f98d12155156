import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from procmatch.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


ENCODER = packing.Encoder(PATH)
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "a", "Foo", "é", "ß.", "<|endoftext|>", "12", "'s", "!!", " ", "\r\n", "日本", "😀", "​", "-", "\x1c", " ", "\x85"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=30)), max_size=5))
def test_ids_are_the_tokenizers(texts):
    own = Tokenizer.from_file(PATH) if not hasattr(test_ids_are_the_tokenizers, "t") else test_ids_are_the_tokenizers.t
    test_ids_are_the_tokenizers.t = own
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(40, 50))
def test_best_fit(lengths, capacity):
    n = np.asarray(lengths)
    place, offset, fill = packing.best_fit_decreasing(n, capacity)
    assert fill.max() <= capacity and fill.sum() == n.sum()
    for b in range(len(fill)):
        at = sorted((offset[i], n[i]) for i in np.flatnonzero(place == b))
        assert [a for a, _ in at] == [0, *np.cumsum([m for _, m in at])[:-1].tolist()]
    least = packing.lower_bound(np.bincount(n, minlength=capacity + 1))
    assert -(-int(n.sum()) // capacity) <= least <= len(fill)


def brute_bins(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bound_is_a_bound(lengths):
    assert packing.lower_bound(np.bincount(lengths, minlength=13)) <= brute_bins(sorted(lengths, reverse=True), 12)


def test_pack_documents(spark, tokenizer):
    rows = [(1, None, 1), (2, "", 1), (3, "one two three", 1), (3, "one two three", 1), (None, "four", 1), (5, "word " * 1200, 1), (6, "é" * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = packing.pack_documents(docs, PATH, capacity=64, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for key, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in by[key]), key=lambda r: (r["row"]))
        assert sum(r["length"] for r in mine) == len(ids) * (2 if key == 3 else 1)
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes()) and list(r["ids"]) == part
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64 and len(ends) == packing.lower_bound(np.bincount([r["length"] for r in got], minlength=65))
    assert packing.sequences(packing.pack_documents(docs, PATH, capacity=64, with_ids=True)).count() == len(ends)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_exchange_merges_groups(spark):
    """Many small groups: bins with room meet in later rounds, and the count comes to the bound."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 3000).tolist()
    pieces = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, capacity=100, group=200).toPandas()
    assert len(got) == 3000
    bins = got["sequence_id"].nunique()
    assert bins <= packing.lower_bound(np.bincount(lengths, minlength=101)) * 1.01
    assert (got["group_bins"] >= got["group_bound"]).all() and (got["group_bound"] > 0).all()


def test_memory_of_chunks_is_bounded(monkeypatch):
    own = packing.Encoder(PATH)
    monkeypatch.setattr(packing, "REMEMBERED", 10_000)
    texts = [f"chunk{i} of text{i}" for i in range(500)]
    for t in texts:
        own([t])
        assert own.size < 12_000
    assert b"".join(own(texts)) == b"".join(ENCODER(texts))


def test_other_pre_tokenizers_get_whole_texts(tmp_path):
    import json

    made = json.loads(Tokenizer.from_file(PATH).to_str())
    made["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(made))
    own = packing.Encoder(str(tmp_path / "t.json"))
    assert not own.cuts and np.frombuffer(own(["Some Text  here"])[0], "<u4").tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode("Some Text  here", add_special_tokens=False).ids
