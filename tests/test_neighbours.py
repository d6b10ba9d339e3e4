"""Matching by blocks against all distances."""

import math

import numpy as np
import pytest

from carrierscan.operators.neighbours import nearest_with_ties


def plain(base, other, k):
    found = set()
    for g, _, x in base:
        far = [(math.dist(x, y), i) for h, i, y in other if h == g]
        kth = sorted(d for d, _ in far)[min(k, len(far)) - 1] if far else 0
        found |= {(g, i) for d, i in far if d <= kth + 1e-9}
    return found


@pytest.mark.parametrize(("k", "block", "grid"), [(1, 4, 3), (3, 16, 1000), (3, 7, 5), (40, 8, 4), (2, 1024, 50)])
def test_blocks_give_what_all_distances_give(spark, k, block, grid):
    random = np.random.default_rng(k + block)
    points = [(None if i % 9 == 0 else i % 3 if i % 2 else 0, i, tuple(float(x) / grid * 10 for x in random.integers(0, grid, 2))) for i in range(260)]
    points += [(7, 1000 + i, (1.0, 2.0)) for i in range(30)] + [(8, 2000, (0.0, 0.0)), (8, 2001, (1.0, 1.0))]
    base, other = [p for p in points if p[1] % 6 == 0], [p for p in points if p[1] % 6]
    frame = lambda rows: spark.createDataFrame([(g, i, *x) for g, i, x in rows] + [(0, 9999 + len(rows), None, 1.0)], "g int, id long, a double, b double").repartition(3)
    got = nearest_with_ties(frame(base), frame(other), ["a", "b"], ["g"], k, block).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain(base, other, k)
    whole = nearest_with_ties(frame(base), frame(other), ["a", "b"], [], k, block).collect()
    assert {(0, r["id"]) for r in whole} == plain([(0, i, x) for _, i, x in base], [(0, i, x) for _, i, x in other], k)


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], "g int, id long, a double")
    some = spark.createDataFrame([(1, 1, 0.5)], "g int, id long, a double")
    assert nearest_with_ties(none, some, ["a"], ["g"], 3).collect() == [] == nearest_with_ties(some, none, ["a"], ["g"], 3).collect()
