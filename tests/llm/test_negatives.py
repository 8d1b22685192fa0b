from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from tideline.llm import negatives, queries, vantage

SCHEMA = "vec_id long, label int, vec array<long>, score string, window int"  # two names that clash with the search's own
SMALL = negatives.Sizes(cell_rows=40, leaf_rows=8, sample=32)


def brute(given, every=5, pos=5, neg=5, low=80, high=100):
    valid = {(i, lab, tuple(v)) for i, lab, v, *_ in given if i is not None and lab is not None and v is not None and None not in v}
    dim = max((len(v) for *_, v in valid), default=0)
    valid = [(i, lab, np.array(v + (0,) * (dim - len(v)))) for i, lab, v in valid]
    out = []
    for a, label, v in (r for r in valid if r[0] % every == 0):
        scored = sorted((-int(v @ w), i, lab) for i, lab, w in valid)
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:pos]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:neg]
            out += [(a, i, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, given, sizes=SMALL, every=5, **more):
    frame = spark.createDataFrame(given, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in negatives.hard_negatives(frame, negatives.F.col("vec_id") % every == 0, sizes=sizes, **more).collect())


def drawn(seed, n, dim, spread, labels=3, clusters=6):
    r = np.random.default_rng(seed)
    centres = r.integers(-50, 50, (clusters, dim))
    return [(k, int(r.integers(labels)), [int(x) for x in centres[r.integers(clusters)] + r.integers(-spread, spread + 1, dim)], "s", 1) for k in range(n)]


@pytest.mark.parametrize(("dim", "spread"), [(2, 3), (8, 40), (1, 0)])
def test_against_all_pairs(spark, dim, spread):
    given = drawn(dim, 300, dim, spread)
    assert mined(spark, given) == brute(given)


def test_copies_nulls_and_ragged_vectors(spark):
    given = drawn(3, 120, 3, 20)
    given += [(1000 + k, k % 2, [7, 7, 7], None, None) for k in range(130)]  # one vector with two labels, a half of the rows
    given += [given[0]] * 40 + [(None, 1, [1, 2, 3], None, None), (2005, None, [1, 2, 3], None, None), (2010, 1, None, None, None), (2015, 1, [1, None, 3], None, None)]
    given += [(3000, 1, [9], None, None), (3005, 2, [], None, None), (3010, 0, [0, 0, 0], None, None), (3015, 9, [40, 40, 40], None, None)]
    assert mined(spark, given) == brute(given)
    assert mined(spark, given, positives=2, negatives=1, low=50, high=90) == brute(given, pos=2, neg=1, low=50, high=90)


def test_empty_results(spark):
    assert mined(spark, []) == []
    one = drawn(1, 40, 2, 5, labels=1)
    assert mined(spark, one) == []
    assert mined(spark, one, every=1000) == []
    with pytest.raises(ValueError):
        mined(spark, [(1, 1, [1 << 40, 1], None, None)])


def test_trees_keep_every_row_and_their_bounds():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-9, 9, (200, 3)), np.full((50, 3), 4)]).astype(float)
    most = float((x**2).sum(1).max())
    wide = vantage.augmented(x, most)
    q = r.integers(-9, 9, (20, 3)).astype(float)
    for tree in (vantage.grow(wide, most_rows=16), vantage.grow(wide, parts=11)):
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(250))
        high, low = tree.bounds(q, most)
        for k, leaf in enumerate(tree.leaves):
            score = q @ x[leaf].T
            assert (score.max(1) <= high[:, k]).all() and (score.min(1) >= low[:, k]).all()
        if tree.nodes[0][0] >= 0 and len(tree.leaves) <= 11:
            routed = tree.route(wide)
            assert all((routed[leaf] == k).all() for k, leaf in enumerate(tree.leaves))
    assert max(map(len, vantage.grow(wide, most_rows=16).leaves)) <= 16


def test_searches_skip_leaves():
    """Where vectors lie in clusters, the bounds leave most leaves out."""
    r = np.random.default_rng(2)
    x = (r.integers(-200, 200, (64, 3))[:, None] + r.integers(-3, 4, (64, 32, 3))).reshape(-1, 3).astype(float)
    most = float((x**2).sum(1).max())
    tree = vantage.grow(vantage.augmented(x, most), most_rows=32)
    seen = []
    asked = vantage.Asked(x[:1], np.zeros(1, int), np.full((1, 1), vantage.LOWEST + 1), np.full((1, 1), -vantage.LOWEST - 1), np.full((1, 1), vantage.LOWEST), True, 5)
    plain, vantage.candidates = vantage.candidates, lambda *a: (seen.append(1), plain(*a))[1]
    try:
        query, _, row, score = vantage.search(tree, x, np.zeros(len(x), int), np.arange(len(x)), most, asked)
    finally:
        vantage.candidates = plain
    want = np.lexsort((np.arange(len(x)), -(x @ x[0])))[:5]
    assert row.tolist() == want.tolist() and len(seen) < len(tree.leaves) / 2


def test_query_against_sql(spark, duck, sf_dir):
    got = queries.op13_hard_negatives(spark, sf_dir)
    assert rows(got) == rows(duck.execute(queries.ORACLE_SQL["op13_hard_negatives"]).df())
