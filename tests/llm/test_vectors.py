"""Exact search, whitening and vector codes: plain versions, bounds, ties, gaps and tables of one hot vector."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrierscan.llm import lloyd, pivots, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, row int, x int, id int, chunk int, _label int"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def awkward():
    """Rows with gaps, repeats, ties, short and empty vectors, and a vector that a third of the rows hold."""
    random = np.random.default_rng(5)
    rows = [(i, (random.standard_normal(6) * (1 if i % 3 else 4)).tolist(), i % 4 or None) for i in range(1, 90)]
    rows += [(1000 + i, [0.5, -0.25, 0.125, 0.0, 1.0, -1.0], 7) for i in range(60)]
    rows += [(20, [1.0, NAN, 0.0, 0.0, 0.0, 0.0], 1), (40, None, 1), (60, [0.1, INF, 0.0, 0.0, 0.0, 0.0], 1), (61, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (80, [], 2), (100, [0.0] * 6, 2), (120, [3.0, -2.0], None), (None, [0.3] * 6, None), (None, [0.3] * 6, 3), (140, [1e300, -1e300, 0.0, 0.0, 0.0, 0.0], 3)]
    rows += [rows[39], rows[39]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)


def integers(rows, scale, width, add=0):
    """(id, label, x) of the rows that take part, as Python integers."""
    most = vectors.magnitude(width)
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, label, [max(-most, min(most, math.floor(scale * c))) + add for c in [*v, *[0.0] * (width - len(v))]]) for i, label, v in kept]


def nearest(kept, k):
    out = []
    for a, (i, _, x) in enumerate(kept):
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j is None, j or 0) for b, (j, _, y) in enumerate(kept) if a != b)[:k]
            out += [(i, rank, None if gone else j, -s) for rank, (s, gone, j) in enumerate(scored, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "most_pivots", "run_rows"), [(5, 4, 8), (20, 64, 16), (200, 3, 1), (1, 1, None)])
def test_search_equals_brute_force(spark, awkward, k, most_pivots, run_rows):
    got = pivots.top_products(frame(spark, awkward), F.col("vec_id") % 20 == 0, k, most_pivots=most_pivots, run_rows=run_rows).collect()
    assert sorted(map(tuple, got), key=str) == nearest(integers(awkward, 64, 6), k)


def test_search_leaves_out_annuli_beyond_reach(spark):
    """Clusters far apart: a query's products are taken with few of the rows, and the result is whole."""
    random = np.random.default_rng(8)
    centres = np.linalg.qr(random.standard_normal((16, 16)))[0]
    x = np.floor(640 * (centres[np.arange(1600) % 16] + 0.02 * random.standard_normal((1600, 16)))).astype(np.int64)
    index = pivots.Pivots(x[:16], int((x * x).sum(axis=1).max()))
    line = index.away(x, index.lifts(x))
    cell = line.argmin(axis=1)
    order = np.lexsort((line.min(axis=1), cell))
    counts = np.bincount(cell, minlength=16)
    asked = x[:40]
    low, high = (np.array([getattr(line[cell == c, c], f)() for c in range(16)]) for f in ("min", "max"))
    ring = pivots.Annuli(np.arange(16), np.arange(16), low, high, counts)
    bound = ring.bounds(index.away(asked, np.zeros(40)))
    product = asked @ x.T
    reach = index.reach(asked, np.sort(product, axis=1)[:, -21])
    assert (bound <= reach[:, None]).mean() < 0.2
    away = np.sqrt(((asked[:, None] - x[None]) ** 2).sum(axis=2) + index.lifts(x) ** 2)
    assert all(bound[q, c] <= away[q, cell == c].min() + 1e-6 for q in range(40) for c in range(16))
    hit, place, score = pivots.search_run(x[order], np.arange(16), counts, line.min(axis=1)[order], order, order, asked, np.arange(40), np.full(40, np.iinfo(np.int64).min), index, 20)
    for q in range(40):
        want = sorted((-product[q, j], j) for j in range(1600) if j != q)[:20]
        assert [(-s, order[p]) for s, p in zip(score[hit == q], place[hit == q], strict=True)] == want


def test_search_of_little_or_nothing(spark):
    assert pivots.top_products(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert pivots.top_products(frame(spark, [(20, [1.0], 1)]), F.col("vec_id") % 20 == 0).collect() == []
    assert pivots.top_products(frame(spark, [(None, [1.0], 1), (3, [2.0], 1)]), F.col("vec_id") % 20 == 0).collect() == []
    two = pivots.top_products(frame(spark, [(20, [1.0], 1), (None, [2.0], 1)]), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in two] == [(20, 1, None, 64 * 128)]


def test_moments_merge_as_one(spark):
    x = np.random.default_rng(2).integers(-500, 500, (1000, 5)) + 1_000_000
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 40, 41, 700])]
    merged = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3])).merge(parts[4])
    assert merged.n == 1000 and merged.total.tolist() == x.sum(axis=0).tolist() == whole.total.tolist()
    assert np.allclose(merged.scatter, np.cov(x.T, bias=True) * 1000, rtol=1e-12) and np.allclose(whole.scatter, merged.scatter, rtol=1e-12)


def whitened(rows, width, components=16):
    """The contract in exact integers and one decomposition."""
    kept = integers(rows, 64, width, 1_000_000)
    fit = np.array(sorted({tuple(x) for _, _, x in kept}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    y = ((fit * n - total) / n).astype(float)
    cov = y.T @ y / n
    values, parts = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return kept, n, total, cov, values[order], parts[:, order]


def test_whitening_equals_the_plain_version(spark, awkward):
    rows = [r for r in awkward if r[1] is None or 1e300 not in r[1]]
    kept, n, total, cov, values, parts = whitened(rows, 6)
    got = {}
    for r in whitening.whiten(frame(spark, rows)).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert sum(map(len, got.values())) == 6 * len(kept)
    for i, _, x in kept:
        exact = [n * a - int(t) for a, t in zip(x, total, strict=True)]
        for c in range(6):
            r = next(r for r in got[i, c + 1] if r["deviation"] == sum(a * a for a in exact))
            assert r["n"] == n
            assert abs(r["whitened"]) == pytest.approx(abs(float(np.array(exact) / n @ parts[:, c]) / math.sqrt(values[c])), rel=1e-8, abs=1e-9)
            assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9) and 0 <= r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    found = whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas()
    assert len(found) == 500 * 16 and found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-9
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.cov(wide.T, bias=True), np.eye(16), atol=1e-9)


def test_whitening_without_variance(spark):
    same = [(i, [0.5, 0.25], 1) for i in range(10)]
    got = whitening.whiten(frame(spark, same)).collect()
    assert len(got) == 20 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    line = whitening.whiten(frame(spark, [*same, (11, [1.5, 0.25], 1), (None, [1.5, 0.25], 1)])).collect()
    assert {(r["n"], r["deviation"], r["whitened"] and round(abs(r["whitened"]), 9), r["explained"]) for r in line} == {(2, 64 * 64, 1.0, 1.0), (2, 64 * 64, None, 0.0)}
    assert {r["identity_error"] for r in line} == {0.0}
    assert whitening.whiten(frame(spark, [])).collect() == [] == whitening.whiten(frame(spark, [(1, None, 1), (2, [NAN], 1)])).collect()


def test_deviations_stay_exact_or_null():
    total = np.array([3 << 40, 5], object)
    small = np.array([[1 << 20, 7]])
    assert whitening.deviations(small, 1 << 20, total) == [((1 << 40) - (3 << 40)) ** 2 + ((7 << 20) - 5) ** 2 if ((2 << 40) ** 2) < 1 << 63 else None]
    assert whitening.deviations(np.array([[1 << 26, 0]]), 1 << 4, np.array([5, 0], object)) == [((1 << 30) - 5) ** 2]
    assert whitening.deviations(np.array([[1 << 26, 0]]), 1 << 40, np.array([5, 0], object)) == [None]


def coded(rows, width, parts=8, entries=16, rounds=6):
    """The contract by loops: code and error by row, labels' sums, and the last codebooks."""
    kept = integers(rows, 4096, width)
    w = width // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, _, x in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(v) // len(groups[j]) for v in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{j:02x}" for _, j in f), e, by[label], digest) for (i, label, _), f, e in zip(kept, found, errors, strict=True)], key=str)


@pytest.mark.parametrize(("parts", "entries", "rounds", "block"), [(3, 16, 6, 2048), (2, 4, 5, 7), (4, 16, 1, 50), (6, 1, 2, 9)])
def test_codes_equal_loops(spark, awkward, monkeypatch, parts, entries, rounds, block):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", block)
    got = lloyd.vector_codes(frame(spark, awkward), parts, entries, rounds).collect()
    assert sorted(map(tuple, got), key=str) == coded(awkward, -(-6 // parts) * parts, parts, entries, rounds)


def test_codes_of_little_or_nothing(spark):
    rows = [(3, [1.0, 2.0], None), (None, [1.0, 2.0], None), (5, [2.0, 0.5], 1)]
    assert sorted(map(tuple, lloyd.vector_codes(frame(spark, rows)).collect()), key=str) == coded(rows, 8)
    assert lloyd.vector_codes(frame(spark, [])).collect() == [] == lloyd.vector_codes(frame(spark, [(1, None, 1)])).collect()
    bare = frame(spark, rows).select("vec_id", "embedding")
    assert {r["label_error"] for r in lloyd.vector_codes(bare).collect()} == {r[3] for r in coded([(i, v, None) for i, v, _ in rows], 8)}


def test_bounds_never_hide_a_nearer_entry_or_a_tie():
    random = np.random.default_rng(4)
    part = random.integers(-6, 7, (4000, 2))
    book = random.integers(-6, 7, (16, 2))
    code, upper, lower = lloyd.scan(part, book)
    scans = []
    for _ in range(12):
        moved = book + random.integers(-1, 2, book.shape) * (random.random(16) < 0.3)[:, None]
        code, upper, lower, scanned = lloyd.reassign(part, code, upper, lower, book, moved)
        book = moved
        scans.append(scanned)
        assert (code == lloyd.squared(part, book).argmin(axis=1)).all()
    assert min(scans) < len(part)
    spread = random.integers(-4000, 4000, (4000, 8))
    book = spread[:16]
    code, upper, lower = lloyd.scan(spread, book)
    moved = book + random.integers(-3, 4, book.shape)
    again, *_, scanned = lloyd.reassign(spread, code, upper, lower, book, moved)
    assert scanned < 200 and (again == lloyd.squared(spread, moved).argmin(axis=1)).all()


def test_registered_names():
    assert {"op11_pivot_topk", "op12_chan_whitening", "op13_hamerly_codes"} <= set(queries.QUERIES)
    assert {"op11_pivot_topk", "op13_hamerly_codes"} <= set(queries.ORACLE_SQL)
