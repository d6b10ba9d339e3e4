"""Wide tables, the genotype store, and ranks of whole tables, each against a plain version."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from carrierscan.operators import order
from carrierscan.sources import store, wide


@pytest.fixture(scope="module")
def wide_folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("wide")
    random = np.random.default_rng(1)
    columns = {f"{1 + i % 3}_{100 + i}_A_G": pa.array(random.integers(-1, 4, 40), pa.int8()) for i in range(300)}
    columns["text"] = pa.array([str(x) if x else None for x in ("0", "1", " 2 ", ".", "", "1.0", "nan", "x", "3", None)] * 4)
    columns["real"] = pa.array([0.0, 1.5, 2.0, float("nan"), None, -1.0, 2.5, 1.0] * 5)
    table = pa.table({"id": [f"s{i}" for i in range(40)], "age": list(range(40)), **columns})
    pq.write_table(table, where / "gen.parquet", row_group_size=15)
    return where


def plain(folder, names):
    out = set()
    for r in pq.read_table(folder / "gen.parquet").to_pylist():
        for c in names:
            v = r[c]
            try:
                v = float(v)
                v = int(v) if 0 <= v <= 2 else None
            except (TypeError, ValueError):
                v = None
            out.add((r["id"], c, v))
    return out


def test_wide_table_by_blocks_of_columns(spark, wide_folder):
    names = [n for n in pq.read_schema(wide_folder / "gen.parquet").names if n not in ("id", "age")]
    cells = wide.read_wide(spark, str(wide_folder), not_variants=["age"], block_columns=64)
    assert cells.rdd.getNumPartitions() == 3 * math.ceil(len(names) / 64)
    assert {tuple(r) for r in cells.collect()} == plain(wide_folder, names)
    some = wide.read_wide(spark, str(wide_folder), variants=["1_100_A_G", "text", "gone"])
    assert some.rdd.getNumPartitions() == 3 and {tuple(r) for r in some.collect()} == plain(wide_folder, ["1_100_A_G", "text"])
    listed = wide.wide_columns(spark, str(wide_folder), not_variants=["age"]).collect()
    assert sorted(r["variant"] for r in listed) == sorted(names)
    wanted = spark.createDataFrame([("text",), ("gone",), ("gone",)], "variant string")
    assert [r[0] for r in wide.missing_variants(spark, str(wide_folder), wanted).collect()] == ["gone"]


def test_many_columns_plan(spark, tmp_path):
    pq.write_table(pa.table({"id": ["a", "b"], **{f"v{i}": pa.array([i % 3, None], pa.int8()) for i in range(30_000)}}), tmp_path / "g.parquet")
    got = wide.read_wide(spark, str(tmp_path)).groupBy("dosage").count().collect()
    assert {r["dosage"]: r["count"] for r in got} == {0: 10_000, 1: 10_000, 2: 10_000, None: 30_000}


CELLS = [(s, f"{c}_{p}_A_G", c, p, None if (p * 7 + k) % 5 == 0 else (p + k) % 3) for k, s in enumerate(("b", "a", "c")) for c in ("1", "2", "X") for p in (10, 20, 30)] + [("d", "1_10_A_G", "1", 10, 2), ("a", "9_5_A_G", "9", 5, None)]


def cells(spark):
    return spark.createDataFrame([*CELLS, ("d", "1_10_A_G", "1", 10, 1)], "sample_id string, variant string, chrom string, pos long, dosage int")


def test_store_is_pruned_and_whole(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return cells(spark)

    one = store.GenotypeStore(spark, str(tmp_path), {"maf": 0.1, "ld": 50}).get_or_build(make)
    again = store.GenotypeStore(spark, str(tmp_path), {"ld": 50, "maf": 0.1}).get_or_build(make)
    assert made == [1] and again.path == one.path
    assert [(r["sample_id"], r["place"]) for r in one.samples().orderBy("place").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    want = {(s, v): d for s, v, _, _, d in CELLS} | {("d", "1_10_A_G"): 1}
    got = {(r["sample_id"], r["variant"]): r["dosage"] for r in one.cells().collect()}
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None} and len(got) == 4 * 10
    part = one.variants(chroms=["2", "X"], first=15, last=25)
    assert {r["variant"] for r in part.collect()} == {"2_20_A_G", "X_20_A_G"}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "chrom" in plan.split("PartitionFilters")[1][:80] and "GreaterThanOrEqual(pos,15)" in plan
    assert {r["sample_id"] for r in one.cells(labels=["1_30_A_G"]).where("dosage is not null").collect()} == {s for (s, v), d in want.items() if v == "1_30_A_G" and d is not None}
    other = store.GenotypeStore(spark, str(tmp_path), {"maf": 0.2, "ld": 50})
    assert not other.ready() and other.path != one.path
    one.get_or_build(make, force=True)
    store.remove(spark, f"{one.path}/manifest")
    assert not one.ready() and one.get_or_build(make).ready() and len(made) == 3


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_and_running_least(spark, by):
    random = np.random.default_rng(3)
    rows = [(int(i), None if i % 13 == 0 else int(random.integers(0, 3)) if i > 60 else 7, float(random.integers(0, 30)) / 10, float(random.random())) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, g int, p double, q double").repartition(5)
    got = order.running_least(order.ranked(df, [F.col("p")], by, "rank", "n"), "q", "rank", by, "least").collect()
    assert sorted(r["i"] for r in got) == list(range(200))
    groups = {}
    for r in got:
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in members] == list(range(1, len(members) + 1)) and {r["n"] for r in members} == {len(members)}
        assert [r["p"] for r in members] == sorted(r["p"] for r in members)
        assert [r["least"] for r in members] == [min(m["q"] for m in members[k:]) for k in range(len(members))]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 400 + [1.0], [float(i * 7919 % 1000) for i in range(1000)], [1.0] * 300 + [2.0] * 300, [0.1 * i for i in range(501)] + [math.inf, -math.inf], [1e-300 * i for i in range(700)]])
def test_quantile_by_counting_probes(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        at = (len(values) - 1) * share
        low, high = sorted(values)[int(at)], sorted(values)[min(len(values) - 1, int(at) + 1)]
        want = low if at == int(at) else low + (high - low) * (at - int(at))
        assert order.exact_quantile(df, F.col("x"), share, most=10) == want
    assert order.exact_quantile(df.where("x is null"), F.col("x")) is None


@pytest.mark.parametrize("by", [["g"], []])
def test_running_minima_read_no_frame_to_the_end_of_a_group(spark, by, capsys):
    from carrierscan.operators import statistics

    rows = [(i, i % 2, None if i % 9 == 0 else (i * 37 % 50) / 50) for i in range(400)]
    out = statistics.benjamini_hochberg(spark.createDataFrame(rows, "k int, g int, p double"), "p", by)
    got = {r["k"]: r["fdr"] for r in out.collect()}
    for g in (0, 1) if by else (None,):
        known = sorted((p, k) for k, group, p in rows if p is not None and g in (None, group))
        least = 1.0
        for i in range(len(known), 0, -1):
            least = min(least, known[i - 1][0] * len(known) / i)
            assert got[known[i - 1][1]] == pytest.approx(least, abs=1e-12)
    assert all(got[k] is None for k, _, p in rows if p is None)
    out.explain()
    assert "currentrow$(), unboundedfollowing" not in capsys.readouterr().out


@pytest.mark.parametrize("by", [["g"], []])
def test_average_ranks_number_different_values_alone(spark, by):
    rows = [(i, [None, "a", "b"][i % 3], None if i % 11 == 0 else float(i * 7 % 20)) for i in range(300)]
    got = order.average_ranks(spark.createDataFrame(rows, "k int, g string, x double"), "x", by, "r", "n").collect()
    assert len(got) == 300
    for r in got:
        group = [x for _, g, x in rows if not by or g == r["g"]]
        known = sorted(x for x in group if x is not None)
        want = None if r["x"] is None else known.index(r["x"]) + (known.count(r["x"]) + 1) / 2
        assert (r["r"], r["n"]) == (want, len(group))
