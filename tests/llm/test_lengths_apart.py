"""Which rows of a bucket are still to be compared."""

import random

from procmatch.llm import omh


def test_rows_without_a_fitting_length_of_another_class_go(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), i, rng.choice([1, 4, 5, 8, 10, 40, 50, 51, 63, 64, 80, 100, 500, 20_000]), rng.randrange(4)) for i in range(400)]
    # A hot bucket of one class, and one far longer text of another.
    rows += [(99, 1000 + i, 100 + i % 3, 7) for i in range(200)] + [(99, 2000, 400, 8)]
    got = {r["id"] for r in omh._apart(spark.createDataFrame(rows, "band long, id long, words int, class long")).collect()}
    fit = lambda a, b: min(a, b) >= 0.8 * max(a, b) - 1e-9
    needed = {i for band, i, n, c in rows if any(band == z and c != k and fit(n, m) for z, _, m, k in rows)}
    assert needed <= got
    near = {i for band, i, n, c in rows if any(band == z and c != k and min(n, m) >= 0.8**1.34 * max(n, m) for z, _, m, k in rows)}
    assert got - {i for band, i, n, c in rows if any(band == z and i != j and min(n, m) >= 0.8**2.7 * max(n, m) for z, j, m, _ in rows)} == set() and len(got) < len(rows)
    assert not got & {i for band, i, *_ in rows if band == 99}
    assert near >= needed


def test_rows_apart_need_no_join_by_length(spark):
    """Rows of a hot bucket with all lengths stay where they are, and exactly those with another class near their own length are left."""
    rng = random.Random(5)
    rows = [(1, i, int(1.2 ** rng.randrange(40)), 0 if i % 50 else i) for i in range(3000)] + [(2 + i // 2, 5000 + i, rng.randrange(20, 40), i % 3) for i in range(3000)]
    width = (1e-6 - omh.math.log(omh.SIMILARITY)) / omh.LENGTHS
    place = lambda n: int(omh.math.floor(omh.math.log(max(n, 1)) / width))
    classes = {}
    for band, _, n, c in rows:
        classes.setdefault((band, place(n)), set()).add(c)
    want = {i for band, i, n, c in rows if any(classes.get((band, place(n) + k), set()) - {c} for k in range(-omh.LENGTHS, omh.LENGTHS + 1))}
    got = omh._apart(spark.createDataFrame(rows, "band long, id long, words int, class long"))
    assert sorted(r["id"] for r in got.collect()) == sorted(want) and 0 < len(want) < len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and got.columns == ["band", "id", "words", "class"]
