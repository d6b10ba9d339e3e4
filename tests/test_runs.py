"""Studies from files to tables: steps in order, short-circuit, resume, force, and settings apart."""

import argparse

import numpy as np
import pytest

from carrierscan import cli
from carrierscan.plans import runs
from carrierscan.sources import bgzf, vcf


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    where = tmp_path_factory.mktemp("study")
    random = np.random.default_rng(7)
    n = 150
    ids = [f"S{i:03}" for i in range(n)]
    e, sex = random.gamma(2, 15, n).round(2), random.integers(0, 2, n)
    dosage = {f"1\t{100 + 10 * k}": random.integers(0, 3, n) for k in range(6)}
    dosage["2\t500"] = random.integers(0, 3, n)
    causal, spread = dosage["1\t100"], dosage["2\t500"]
    y = 61 - 1.2 * sex - 0.25 * (causal > 0) * (e - 30) + random.standard_normal(n) * (2 + 5 * (spread > 0))
    (where / "env.csv").write_text("id,onset_age,exposure_env,sex,site\n" + "".join(f"{i}_{i},{y[k]:.2f},{e[k]},{'M' if sex[k] else 'F'},{('bulbar', 'limb', '.')[k % 3]}\n" for k, i in enumerate(ids)))
    (where / "pca.csv").write_text("IID,PC1,PC2\n" + "".join(f"{i},{random.standard_normal():.4f},{random.standard_normal():.4f}\n" for i in ids))
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *ids])]
    lines += ["\t".join(["chr" + k.split("\t")[0], k.split("\t")[1], ".", "A", "G", ".", ".", ".", "GT", *(("0/0", "0/1", "1/1")[d] for d in v)]) for k, v in dosage.items()]
    raw = ("\n".join(lines) + "\n").encode()
    (where / "g.vcf.gz").write_bytes(b"".join(bgzf.pack(raw[at : at + 900]) for at in range(0, len(raw), 900)) + bgzf.END)
    return where


def arguments(files, root, command, *more):
    return [command, "--genotypes", str(files / "g.vcf.gz"), "--kind", "vcf", "--samples", str(files / "env.csv"), "--components", str(files / "pca.csv"), "--root", str(root), "--generation", "gen1", "--exposure", "exposure_env", "--covariate", "sex", "--parts", "2",
            "--setting", "scan_reps=30", "--setting", "n_perm=60", "--setting", "n_perm_high=200", "--setting", "candidate_top=2", "--setting", "top_loci=1", "--setting", "components=2", "--setting", "min_obs_coef=0.5", "--setting", "max_smd=0.5", *more]


def cli_arguments(files):
    return argparse.Namespace(samples=str(files / "env.csv"), components=None, sep=",", decimal=".", covariate=["sex"], category=["site"])


def test_variance_study_from_files(spark, files, tmp_path):
    first = cli.main(arguments(files, tmp_path, "variance"), spark)
    assert first.made == ["variants", "scan/part-000", "scan/part-001", "candidates", "interaction", "loci", "rge", "robustness", "permutation"]
    scan = {r["variant"]: r for r in first.table("candidates").collect()}
    assert len(scan) == 7 and {v for v, r in scan.items() if r["is_candidate"]} >= {"2_500_A_G"} and sum(r["is_candidate"] for r in scan.values()) == 2
    assert {r["variant"] for r in first.table("interaction").collect()} == {v for v, r in scan.items() if r["is_candidate"]}
    assert first.table("robustness").count() == 4 and first.table("permutation").count() == 1
    again = cli.main(arguments(files, tmp_path, "variance"), spark)
    assert again.path == first.path and again.made == []
    assert [tuple(r) for r in again.status(runs.STEPS["variance"]).collect()][0] == ("variants", True, 7)
    other = cli.main([*arguments(files, tmp_path, "status"), "--setting", "alpha=0.01"], spark)
    assert other.path != first.path and not any(r["done"] for r in other.status(runs.STEPS["variance"]).collect())


def test_model_study_resumes_where_it_broke_off(spark, files, tmp_path, monkeypatch):
    calls, real = [], runs.scans.two_phase_model

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(runs.scans, "two_phase_model", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        cli.main(arguments(files, tmp_path, "model"), spark)
    run = cli.main(arguments(files, tmp_path, "model"), spark)
    assert run.made == ["scan/part-001", "model", "significant"] and len(calls) == 3
    rows = {r["variant"]: r for r in run.table("model").collect()}
    assert len(rows) == 7 and rows["1_100_A_G"]["empirical_p"] < 0.05 and {r["variant"] for r in run.table("significant").collect()} >= {"1_100_A_G"}
    people = cli.samples(spark, cli_arguments(files), runs.StudyConfig(exposures=("exposure_env",)))
    assert "site_limb" in people.columns and people.where("site_limb = 1").count() == 50
    by_site = cli.main([*arguments(files, tmp_path, "model"), "--category", "site", "--setting", "n_perm=20", "--setting", "n_perm_high=20"], spark)
    assert by_site.path != run.path and by_site.table("model").count() == 7
    anew = cli.main([*arguments(files, tmp_path, "model"), "--force"], spark)
    assert len(anew.made) == 5
    assert {(r["variant"], r["empirical_p"]) for r in anew.table("model").collect()} == {(v, r["empirical_p"]) for v, r in rows.items()}


def test_the_first_of_two_runs_wins(spark, tmp_path):
    config = runs.StudyConfig()
    one, two = (runs.Generation(spark, str(tmp_path), "g", config) for _ in range(2))

    def late():
        one.get_or_make("t", lambda: spark.range(3).toDF("x"))
        return spark.range(5).toDF("x")

    assert two.get_or_make("t", late).count() == 3 and one.table("t").count() == 3
    assert vcf.bare("chr7") == vcf.bare("7") == "7"
