"""Pruning, components and kinship in blocks against dense versions of the whole."""

import numpy as np
import pytest

from carrierscan.operators import genotypes, linkage


def correlated(random, samples, variants):
    """Dosages whose neighbours go together, with missing cells, constant variants and equal ones."""
    base = random.integers(0, 3, samples)
    out = []
    for v in range(variants):
        base = np.where(random.random(samples) < 0.25, random.integers(0, 3, samples), base)
        one = base.astype(float)
        if v % 11 == 3:
            one[:] = 1
        if v % 7 == 2 and out:
            one = out[-1].copy()
        one[random.random(samples) < 0.05] = np.nan
        out.append(one)
    out[5][:] = np.nan
    return np.array(out)


def frame(spark, chroms):
    rows = [(f"s{j:03}", f"v{c}_{i:03}", c, 10 * i, None if np.isnan(x) else int(x)) for c, values in chroms.items() for i, one in enumerate(values) for j, x in enumerate(one)]
    return spark.createDataFrame(rows, "sample_id string, variant string, chrom int, pos int, dosage int")


def plainly_pruned(values, window, step, r2):
    some = ~np.isnan(values).all(axis=1)
    mean = np.zeros(len(values))
    mean[some] = np.nanmean(values[some], axis=1)
    filled = np.where(np.isnan(values), mean[:, None], values)
    maf = np.minimum(mean / 2, 1 - mean / 2)
    centred = filled - filled.mean(axis=1, keepdims=True)
    norm = (centred**2).sum(axis=1)
    keep = norm > 1e-9
    for start in range(0, max(1, len(values) - window + step), step):
        for i in range(start, min(start + window, len(values))):
            for j in range(i + 1, min(start + window, len(values))):
                if keep[i] and keep[j] and (centred[i] @ centred[j]) ** 2 > r2 * norm[i] * norm[j]:
                    keep[i if maf[i] < maf[j] else j] = False
    return keep, maf


@pytest.mark.parametrize(("window", "step", "r2", "block", "slices"), [(8, 3, 0.2, 8, 16), (8, 1, 0.1, 9, 1000), (5, 5, 0.4, 64, 7), (20, 5, 0.05, 20, 30)])
def test_pruning_in_blocks_equals_the_whole(spark, window, step, r2, block, slices):
    random = np.random.default_rng(window)
    chroms = {1: correlated(random, 50, 70), 2: correlated(random, 50, 23), 3: correlated(random, 50, 8)}
    got = {(r["chrom"], r["pos"]): r["maf"] for r in linkage.ld_prune(frame(spark, chroms), window, step, r2, block=block, slice_samples=slices).collect()}
    want = {}
    for c, values in chroms.items():
        keep, maf = plainly_pruned(values, window, step, r2)
        want |= {(c, 10 * i): maf[i] for i in np.flatnonzero(keep)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert 5 < len(want) < 90


def test_state_is_handed_through_a_chain_of_blocks(spark):
    """A chain in which each variant's fate hangs on the one before it, over many blocks."""
    edges = spark.createDataFrame([(1, i, i + 3, i + 3) for i in range(0, 90)], "chrom int, i long, j long, loser long")
    got = sorted(r["idx"] for r in linkage.greedy(edges, 1, 4, 5).collect())
    gone = set()
    for i in range(90):
        if i not in gone and i + 3 not in gone:
            gone.add(i + 3)
    assert got == sorted(gone)


def test_components_equal_the_dense_decomposition(spark):
    random = np.random.default_rng(1)
    groups = np.repeat([0, 1, 2], 20)
    share = np.clip(0.5 + 0.35 * random.standard_normal((200, 3)), 0.05, 0.95)
    values = (random.random((200, 60)) < share[:, groups]).astype(float) + (random.random((200, 60)) < share[:, groups])
    values[random.random(values.shape) < 0.03] = np.nan
    values[7] = 2
    got = linkage.principal_components(frame(spark, {1: values}), 2).orderBy("sample_id").collect()
    p = np.nanmean(values, axis=1) / 2
    used = (p > 0) & (p < 1)
    x = np.where(np.isnan(values), 0, (values - 2 * p[:, None]) / np.sqrt(np.where(used, 2 * p * (1 - p), 1))[:, None])[used]
    top = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :2]
    found = np.array([[r["pc1"], r["pc2"]] for r in got])
    assert np.allclose(np.abs((found * top).sum(axis=0)), 1, atol=1e-6) and (found[np.abs(found).argmax(axis=0), [0, 1]] > 0).all()
    few = linkage.principal_components(frame(spark, {1: values[:, :3]}), 5).collect()
    assert len(few) == 3 and len(few[0]) == 4


def test_kinship_in_blocks_and_slices(spark):
    random = np.random.default_rng(4)
    values = correlated(random, 30, 40)
    got = {(r["id1"], r["id2"]): r for r in genotypes.king_kinship(frame(spark, {1: values}), 7, 9).collect()}
    assert len(got) == 30 * 29 / 2
    for a in range(30):
        for b in range(a + 1, 30):
            x, y = values[:, a], values[:, b]
            both = ~(np.isnan(x) | np.isnan(y))
            x, y = x[both], y[both]
            r = got[f"s{a:03}", f"s{b:03}"]
            het, ibs0, h1, h2 = int(((x == 1) & (y == 1)).sum()), int((np.abs(x - y) == 2).sum()), int((x == 1).sum()), int((y == 1).sum())
            low = min(h1, h2)
            assert (r["n_snp"], r["het_het"], r["ibs0"]) == (both.sum(), het, ibs0)
            assert r["kinship"] == (pytest.approx((het - 2 * ibs0) / (2 * low) + 0.5 - (h1 + h2) / (4 * low)) if low else None)


def test_kinship_moves_no_pairs(spark, capsys):
    genotypes.king_kinship(frame(spark, {1: correlated(np.random.default_rng(4), 30, 40)}), 7, 9).explain()
    plan = capsys.readouterr().out
    assert plan.index("MapInArrow") < plan.index("Exchange") and "id1" not in plan[plan.index("Exchange") :]


def test_components_by_way_of_few_variants_equal_the_iteration(spark, monkeypatch):
    values = correlated(np.random.default_rng(6), 60, 25)
    few = linkage.principal_components(frame(spark, {1: values}), 3).orderBy("sample_id").collect()
    monkeypatch.setattr(linkage, "BLOCK_ENTRIES", 1)
    assert np.allclose([tuple(r)[1:] for r in linkage.principal_components(frame(spark, {1: values}), 3).orderBy("sample_id").collect()], [tuple(r)[1:] for r in few], atol=1e-9)
    monkeypatch.setattr(linkage, "FEW_VARIANTS", 0)
    many = linkage.principal_components(frame(spark, {1: values}), 3, most_rounds=500, tolerance=1e-13).orderBy("sample_id").collect()
    assert np.allclose([tuple(r)[1:] for r in many], [tuple(r)[1:] for r in few], atol=1e-5)
