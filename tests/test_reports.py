"""Report tables against plain versions."""

import statistics as st

import numpy as np
import pytest

from carrierscan.functions import distributions as D
from carrierscan.plans import reports


def test_cohort_table_lines(spark):
    random = np.random.default_rng(8)
    rows = [("A" if i % 2 else "B" if i % 3 else "C", float(random.standard_normal() + i % 2), float(random.exponential() ** 3), None if i % 10 == 0 else "xyz"[int(random.integers(0, 3))], "pq"[int(random.random() < 0.04)]) for i in range(150)]
    df = spark.createDataFrame(rows, "cohort string, age double, dose double, site string, rare string").repartition(3)
    got = reports.cohort_table(df, "cohort", "A", "B", ["age", "dose"], ["site", "rare"], {"age": "Age", "site": "Site"}).orderBy("place").collect()
    assert [r["variable"] for r in got] == ["Site", "Site - y", "Site - z", "rare", "rare - q", "Age", "dose"]
    a, b = ([r for r in rows if r[0] == c] for c in "AB")
    site = [[sum(r[3] == x for r in g) for g in (a, b)] for x in "xyz"]
    totals = [sum(c) for c in zip(*site, strict=True)]
    for line, counts in zip(got, site, strict=False):
        assert [line["group1_stat"], line["group2_stat"]] == [f"{n} ({100 * n / t:.1f}%)" for n, t in zip(counts, totals, strict=True)]
        assert (line["group1_n"], line["group2_n"]) == tuple(totals)
    expected = [[sum(c) * t / sum(totals) for t in totals] for c in site]
    chi2 = sum((o - e) ** 2 / e for c, x in zip(site, expected, strict=True) for o, e in zip(c, x, strict=True))
    assert got[0]["test"] == "Chi-square" and got[0]["p_value"] == pytest.approx(D.chi2_sf(chi2, 2)) and (got[1]["test"], got[1]["p_value"], got[1]["p_value_fmt"]) == ("", None, "")
    assert got[3]["test"] == "Fisher exact"
    age = [[r[1] for r in g] for g in (a, b)]
    assert got[5]["test"] == "Welch t-test" and [got[5]["group1_stat"], got[5]["group2_stat"]] == [f"{st.mean(x):.2f} ± {st.stdev(x):.2f}" for x in age]
    assert got[5]["p_value_fmt"] == ("<0.001" if got[5]["p_value"] < 0.001 else f"{got[5]['p_value']:.3f}")
    dose = [[r[2] for r in g] for g in (a, b)]
    assert got[6]["test"] == "Mann–Whitney U" and [got[6]["group1_stat"], got[6]["group2_stat"]] == [f"{np.median(x):.2f} [{np.quantile(x, 0.25):.2f}-{np.quantile(x, 0.75):.2f}]" for x in dose]


def test_filters_by_file(spark):
    cells = [(f"{'X' if i == 0 else 's'}{i}", v, "1", p, f, d) for i in range(12) for v, p, f, d in (("a", 1, "f1", i % 3), ("b", 2, "f1", i % 3), ("c", 3, "f1", (i // 3) % 3), ("d", 4, "f1", 0), ("e", 1, "f2", int(i == 0)))]
    df = spark.createDataFrame(cells, "sample_id string, variant string, chrom string, pos int, path string, dosage int")
    got = {r["file"]: tuple(r)[1:] for r in reports.filter_statistics(df, "path", ["X"], 0.1).collect()}
    assert got == {"f1": (12, 1, 4, 3, 2), "f2": (12, 1, 1, 0, 0)}
