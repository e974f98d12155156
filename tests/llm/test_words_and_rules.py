"""Spelling variants, the rule cascade and source divergence against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from procmatch.llm import cascade, divergence, spelling

DOCS = "doc_id long, text string, lang string, source string"


def edits(word):
    """All strings one deletion away, with the place."""
    return {(i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(d == short for _, d in edits(long))


def brute_variants(docs, least_length, least_count, ratio, slip):
    import re

    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least_count}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], k, len(near[w]), n[form[w]] if form[w] else None) for w, k in n.items()}


@pytest.mark.parametrize("seed", range(3))
def test_variants_against_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abé" if seed else "abcdeé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(120)]
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else words[min(int(rng.expovariate(0.05)), 119)] for _ in range(60))) for i in range(40)]
    docs += [(None, words[0]), (None, None), (5, ""), (5, docs[5][1]), (5, docs[5][1]), (99, words[1] * 3 + " ×÷ " + "ab" * 400), (98, ("abab" * 300 + " ") * 3)]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS near"), least_length=4, least_count=2, ratio=2, slip=7)
    rows = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(docs, 4, 2, 2, 7)
    assert len(rows) == len(set(rows)) == len(want) and set(rows) == want
    assert any(r[1] for r in rows) and (seed == 0 or any(r[1] and r[2] != r[1] for r in rows))


def test_variants_of_nothing_and_ties(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short a ab")], "doc_id long, text string")).count() == 0
    text = "planets " * 50 + "planeta " * 50 + "planet " * 5 + "Planet " * 5
    row = spelling.variants(spark.createDataFrame([("x", text)], "doc_id string, text string")).where("word = 'planet'").first()
    assert (row["form"], row["root"], row["n"], row["n_near"], row["form_n"]) == ("planeta", "planeta", 10, 2, 50)


def test_pivots_are_disjoint_and_cheapest(spark):
    vocab = spark.createDataFrame([("abcdef", 5), ("aaaaaa", 6), ("abcxyz", 7), ("zzabab", 9)], "word string, n long")
    cost = Counter(g for w in ("abcdef", "aaaaaa", "abcxyz", "zzabab") for g in [w[i : i + 2] for i in range(5)])
    for r in spelling.signatures(vocab).collect():
        at = r["prefix"]
        best = min(cost[r["word"][a : a + 2]] + cost[r["word"][b : b + 2]] for a in at for b in at if b >= a + 2)
        assert r["pivots"]["b"] >= r["pivots"]["a"] + 2 and r["pivots"]["cost"] == best and {r["pivots"]["a"], r["pivots"]["b"]} <= set(at)


def brute_measures(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), sum(1 for i, x in enumerate(lines) if x in lines[:i]), len(hit)


CASES = [None, "", " \n\t", "a", "a a a a", "x y z x y z", "\n".join(["same line"] * 5), "word " * 60, " ".join(f"w{i % 40}ord{i}" for i in range(80)), "one two three four five　six " * 3, "# | $ 12 " * 30, "tab\tand\x0bother\x0cspaces\rhere", " ".join(f"Good{i} text{i * 7}" for i in range(3000))]


def test_measures_against_brute_force(spark):
    rng = random.Random(1)
    texts = CASES + [" ".join(rng.choice(["a", "bb", "c\n", "d"]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "again"), (3, "again")], "doc_id long, text string").selectExpr("*", "'no' AS kept", "0 AS n_words")
    rows = cascade.judge(docs, cascade.RULES).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            want = brute_measures(texts[r["doc_id"]])
            assert tuple(r[m] for m in cascade.MEASURES) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (r["rejected_by"] is None) and not (r["base_failed"] and r["kept"])
            assert r["n_rules"] == 0 if r["base_failed"] else 1 <= r["n_rules"] <= len(cascade.RULES)


def test_windows_of_many_words_count_exactly():
    page = cascade.Page(" ".join(f"w{i}" for i in range(3_000_000)) + " w1 w2 w3")
    assert page.n_repeat_words == 6 and page.n_words == 3_000_003


def test_order_saves_work_and_changes_no_verdict(spark):
    texts = [" ".join(f"word{i}{k}" for k in range(80)) + (" ### |" * 30 if i % 3 == 0 else "") + (" HELLO!! THERE!!" * 30 if i % 5 == 0 else "") for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    planned = cascade.plan(docs)
    assert sorted(r.name for r in planned) == sorted(r.name for r in cascade.RULES)
    a, b, c = (cascade.judge(docs, rules).select("doc_id", "kept", "n_rules").collect() for rules in (planned, cascade.RULES, cascade.RULES[::-1]))
    kept = lambda rows: {r["doc_id"]: r["kept"] for r in rows}
    assert kept(a) == kept(b) == kept(c) and {True, False} == set(kept(a).values())
    assert sum(r["n_rules"] for r in a) <= sum(r["n_rules"] for r in c)
    assert cascade.plan(docs.limit(0)) == cascade.RULES and cascade.judge(docs.limit(0)).count() == 0


def test_order_is_by_rejections_for_their_cost():
    costs = np.array([[1.0, 10.0, 1.0]] * 4)
    rejects = np.array([[True, True, False], [False, True, False], [False, True, False], [False, False, True]])
    # Each of 0 and 2 rejects one for 4, 1 three for 40; after 0 and 2 rule 1 is left with two.
    assert cascade.ordered(costs, rejects) == [0, 2, 1]
    assert cascade.ordered(np.array([[2.0, 1.0]]), np.array([[False, False]])) == [1, 0]


def brute_divergence(docs, min_docs, top):
    import re

    by_lang, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        ts = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        df[lang or ""].update(ts.keys())
        groups[lang or "", source or ""].update(ts)
        by_lang[lang or ""].update(ts)
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        share = lambda c, n: 1 + 10**9 * (c + 1) // n
        size = lambda counts: sum(counts[t] for t in kept) + len(kept)  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        pairs = []
        for (other, item), theirs in groups.items():
            if other == lang and item != source:
                pairs.append((-sum(f(share(own[t], size(own)), share(theirs[t], size(theirs))) for t in kept), item.encode(), item))
        out |= {(lang, source, "pair", item, -v, r) for r, (v, _, item) in enumerate(sorted(pairs), 1)}
        terms = []
        for t in kept:
            p, q = share(own[t], size(own)), share(by_lang[lang][t], size(by_lang[lang]))
            if own[t] and p > q:
                terms.append((-f(p, q), t.encode(), t))
        out |= {(lang, source, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_divergence_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(70)]
    docs = [(" ".join(words[min(int(rng.expovariate(0.08 + 0.01 * (s % 4))), 69)] for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), f"s{s}") for s in (rng.randint(0, 6) for _ in range(120))]
    docs += [(None, "en", "silent"), ("", None, None), ("rare words only", "xx", "one"), ("other rare", "xx", "two"), (docs[0][0], docs[0][1], docs[0][2]), ("A\x00b İ ß " * 2000, "en", "s1")]
    table = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "'x' AS item", "3 AS value")
    got = [tuple(r) for r in divergence.audit(table, top=10).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute_divergence(docs, 3, 10)
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert ("xx", "one", "pair", "two", 0, 1) in want


def test_sums_are_those_of_count_vectorizer(spark):
    """One fit a language, with minDF and the largest vocabulary; sums of its vectors by source; sums don't depend on how many a task holds."""
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql import functions as F

    rng = random.Random(5)
    docs = [(" ".join(f"{rng.choice('abcdefghij')}{rng.choice('xyzé')}" for _ in range(rng.randint(0, 12))), rng.choice(["en", "de"]), rng.choice("pqr")) for _ in range(60)]
    table = spark.createDataFrame(docs, "text string, lang string, source string")
    want = Counter()
    for lang in ("en", "de"):
        words = table.where(F.col("lang") == lang).select("source", F.expr("filter(split(text, ' '), x -> x <> '')").alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=3.0, vocabSize=2**31 - 1).fit(words)
        for r in model.transform(words).collect():
            for i, n in zip(r["v"].indices.tolist(), r["v"].values.tolist(), strict=True):
                want[lang, r["source"], model.vocabulary[i]] += int(n)
    for held in (1, divergence.HELD):
        got = {(r["lang"], r["source"], r["term"]): r["n"] for r in divergence.count(table, held=held).terms.collect()}
        assert got == want


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    alone = divergence.audit(spark.createDataFrame([(1, None, None, None)], DOCS)).collect()
    assert alone == []


def test_common_terms_in_small_parts(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(f"t{t}", f"s{s}", int(rng.integers(1, 10**9)), int(1 + s)) for t in range(30) for s in rng.permutation(9)[: rng.integers(1, 10)]]
    table = pa.table({"term": [r[0] for r in rows], "source": [r[1] for r in rows], "p": [r[2] for r in rows], "p0": [r[3] for r in rows]})
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        for a in own:
            for b in own:
                if a[1] != b[1]:
                    want[a[1], b[1]] += f(a[2], b[2]) - f(a[2], b[3]) - f(a[3], b[2]) + f(a[3], b[3])
    for chunk in (1, 50, 10**6):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        got = Counter()
        for batch in divergence._common(table):
            for r in batch.to_pylist():
                got[r["source"], r["item"]] += r["value"]
        assert got == want
