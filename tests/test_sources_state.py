"""Readers on small files, expressions, resumable results and streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from carrierscan.config import StudyConfig
from carrierscan.functions import expressions as X
from carrierscan.operators import annotation, cohorts, genotypes
from carrierscan.plans import pipelines
from carrierscan.plans.state import ResultStore
from carrierscan.sources import tables, vcf
from carrierscan.streaming import incremental

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3
chr1\t100\t.\tA\tG\t.\t.\t.\tGT:DP\t0/0:3\t0|1:4\t1/1:5
chr1\t200\t.\tA\tC,T\t.\t.\t.\tGT\t1/2\t./.\t2/2
2\t50\t.\tAT\tA\t.\t.\t.\tDP\t1\t2\t3
"""


@pytest.fixture
def files(tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(VCF)
    (tmp_path / "b.vcf").write_text(VCF.split("chr1\t200")[0].replace("S1\tS2\tS3", "T1\tT2\tT3"))
    return tmp_path


def test_vcf(spark, files):
    sites = vcf.read_sites(spark, str(files)).cache()
    assert sites.count() == 4
    assert [r["chrom"] for r in vcf.repeated_chromosomes(sites).collect()] == ["1"]
    one = {(r["variant"], r["sample_id"]): r["dosage"] for r in vcf.to_dosages(sites).collect()}
    assert [one[("1_100_A_G", s)] for s in ("S1", "S2", "S3", "T3")] == [0, 1, 2, 2]
    assert [one[("1_200_A_C", s)] for s in ("S1", "S2", "S3")] == [3, None, 4]
    assert one[("2_50_AT_A", "S1")] is None
    each = vcf.to_dosages(sites, per_alternative=True)
    cells = {(r["variant"], r["sample_id"]): r["dosage"] for r in each.collect()}
    assert [cells[("1_200_A_T", s)] for s in ("S1", "S2", "S3")] == [1, None, 2] and cells[("1_200_A_C", "S3")] == 0
    wanted = spark.createDataFrame([("1", 100, "A", "G"), ("1", 100, "C", "G"), ("9", 1, "A", "G")], "chrom string, pos long, ref string, alt string")
    found, absent = vcf.lookup(each, wanted)
    assert found.count() == 6 and {(r["chrom"], r["position_exists"]) for r in absent.collect()} == {("1", True), ("9", False)}


def test_text_tables(spark, tmp_path):
    (tmp_path / "king.kin0").write_text("#FID1 IID1 FID2 IID2 KINSHIP\nf a f b 0.25\n f a  f c nan\n")
    rows = tables.numbers(tables.whitespace_table(spark, str(tmp_path / "king.kin0"), {"IID1": "id1", "ID1": "id1"}), ["KINSHIP"]).collect()
    assert [(r["id1"], r["KINSHIP"]) for r in rows] == [("a", 0.25), ("a", None)]
    (tmp_path / "ctd.tsv").write_text("# note\n# Input\tGeneSymbol\tOrganism\nx\tsod1\nx\tFUS\tHomo sapiens\textra\n")
    assert [tuple(r) for r in tables.commented_tsv(spark, str(tmp_path / "ctd.tsv")).collect()] == [("x", "sod1", ""), ("x", "FUS", "Homo sapiens")]
    (tmp_path / "env.csv").write_text("id;e\nA;1,5\nB;.\n")
    csv = tables.study_csv(spark, str(tmp_path / "env.csv"), ";", ",")
    assert [r[0] for r in csv.select(X.number(F.col("e"))).collect()] == [1.5, None]
    wide = spark.createDataFrame([("s1", "0", "."), ("s2", "2", "-1")], "id string, 1_5_A_G string, 2_6_C_T string")
    assert {tuple(r) for r in tables.wide_to_long(wide, "id", []).collect()} == {("s1", "1_5_A_G", 0), ("s1", "2_6_C_T", None), ("s2", "1_5_A_G", 2), ("s2", "2_6_C_T", None)}


def test_expressions(spark):
    rows = spark.createDataFrame([("RES1_RES1",), ("gen2_RES9_RES9",), ("A_B",), ("gen4_X",), (None,)], "x string")
    assert [r[0] for r in rows.select(X.clean_sample_id(F.col("x"))).collect()] == ["RES1", "RES9", "A_B", "gen4_X", None]
    assert [r[0] for r in rows.select(X.fold_equal_halves(F.col("x"))).collect()] == ["RES1", "gen2_RES9_RES9", "A_B", "gen4_X", None]
    labels = spark.createDataFrame([("chr1:5",), ("X_77_A_G",), ("chrhX-1",), (None,)], "x string")
    assert [r[0] for r in labels.select(X.chromosome_of(F.col("x"))).collect()] == ["1", "X", "X", "NA"]
    with pytest.raises(Exception, match="unknown sex"):
        spark.createDataFrame([("Q",)], "s string").select(X.sex_code(F.col("s"))).collect()
    names = spark.createDataFrame([("a",), ("b",)], "x string")
    assert [r[0] for r in names.select(X.translated(F.col("x"), {"a": "Alpha"})).collect()] == ["Alpha", "b"]
    assert [r[0] for r in spark.createDataFrame([(0.00001,), (0.25,), (None,)], "p double").select(X.p_text(F.col("p"))).collect()] == ["1.00e-05", "0.250", "NA"]


def test_genotype_filters(spark):
    cells = spark.createDataFrame([(s, v, d) for s in range(6) for v, d in (("a", s % 3), ("b", 0), ("c", None if s < 4 else 1))], "sample_id long, variant string, dosage int")
    assert {r[0] for r in genotypes.drop_monomorphic(cells).select("variant").distinct().collect()} == {"a"}
    assert {r[0] for r in genotypes.keep_called(cells, cells, 0.3).select("variant").distinct().collect()} == {"a", "b"}
    assert genotypes.drop_prefixed_samples(cells, ["1", "2"]).select("sample_id").distinct().count() == 4
    samples = cells.select("sample_id").distinct()
    assert [r["n"] for r in pipelines.quality_attrition(cells, samples, StudyConfig()).orderBy("stage_no").collect()] == [3, 2, 1, 1]


def test_annotation(spark):
    genes = spark.createDataFrame([("g1", "SOD1"), ("g2", "FUS")], "gene_id string, symbol string")
    def payload(text):
        return spark.createDataFrame([("g1", text), ("g2", "no json")], "gene_id string, payload string")

    parts = [
        annotation.brain_expression(payload('{"data":[{"tissueSiteDetailId":"Brain_Cortex","median":2.5,"gencodeId":"E.7"},{"tissueSiteDetailId":"Liver","median":1,"gencodeId":"E.20"}]}')),
        annotation.cell_types(payload('{"RNA single cell type specific nCPM":{"Excitatory neurons":"12","Astrocytes":"3"}}')),
        annotation.panel_confidence(payload('{"results":[{"confidence_level":"3","panel":{"name":"Amyotrophic lateral sclerosis"}},{"confidence_level":"1","panel":{"name":"Other"}}]}')),
        annotation.disease_score(payload('{"data":{"target":{"associatedDiseases":{"rows":[{"score":0.7,"disease":{"name":"amyotrophic lateral sclerosis"}},{"score":0.9,"disease":{"name":"flu"}}]}}}}')),
    ]
    chemicals = annotation.chemical_index(spark.createDataFrame([("sod1", "Homo sapiens", "Paraquat", "1|2"), ("SOD1", "Mus musculus", "Lead", "3")], "GeneSymbol string, Organism string, ChemicalName string, PubMedIDs string"))
    diseases = annotation.disease_index(spark.createDataFrame([("SOD1", "Amyotrophic Lateral Sclerosis", "marker", ""), ("SOD1", "amyotrophic lateral sclerosis", "", "paraquat")], "GeneSymbol string, DiseaseName string, DirectEvidence string, InferenceChemicalName string"))
    rows = {r["gene_id"]: r for r in annotation.annotate(genes, parts, chemicals, diseases).collect()}
    one, two = rows["g1"], rows["g2"]
    assert one["in_brain"] and one["in_neurons"] and one["in_glia"] and one["versioned_id"] == "E.20" and one["panel_confidence"] == "3" and one["disease_score"] == 0.7
    assert one["chemicals"] == ["Paraquat"] and one["has_pesticide"] and one["direct_link"] and one["pesticide_mediated"] and one["pubmed_ids"] == ["1", "2"]
    assert not (two["in_brain"] or two["has_chemicals"] or two["direct_link"]) and two["disease_score"] is None


def test_results_resume(spark, tmp_path):
    universe = spark.createDataFrame([(i,) for i in range(5)], "variant int")
    store = ResultStore(spark, str(tmp_path), "scan", StudyConfig(), ["variant"])
    assert store.read() is None
    first = store.resume(universe, lambda todo: todo.withColumn("status", F.when(F.col("variant") == 3, "failed").otherwise("done")), 1)
    assert first.where("status = 'failed'").count() == 1
    seen = []
    again = store.resume(universe, lambda todo: (seen.append(todo.count()), todo.withColumn("status", F.lit("done")))[1], 2)
    assert seen == [1] and again.count() == 5 and again.where("status = 'done'").count() == 5
    assert ResultStore(spark, str(tmp_path), "scan", StudyConfig(seed=7), ["variant"]).read() is None


def test_cohorts(spark):
    env = spark.createDataFrame([(1, 5.0), (2, 6.0)], "sample_id int, e double")
    pcs = spark.createDataFrame([(1, 0.1), (1, 0.2)], "sample_id int, pc1 double")
    with pytest.raises(Exception, match="repeats"):
        cohorts.with_covariates(env, pcs).collect()
    assert cohorts.resolve_cohort(env, None, 1).count() == 2
    with pytest.raises(ValueError, match="cohort"):
        cohorts.resolve_cohort(env, None, 1, strict=True)
    assert tuple(cohorts.lost_and_kept(env, pcs, "sample_id").head()) == (1, 1)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in cohorts.upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for batch, rows in enumerate(([(1, "x"), (2, "x")], [(2, "y"), (3, "y")])):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(source)
        incremental.append_batches(incremental.stream_results(spark, source, "k int, v string"), target, str(tmp_path / "ck"), ["k"]).awaitTermination()
    assert {(r["k"], r["v"]) for r in incremental.current(spark, target, ["k"]).collect()} == {(1, "x"), (2, "y"), (3, "y")}


def test_csv_latest_and_snapshots(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from carrierscan.plans.state import export_csv

    kind = "variant string, p double, note string"
    first = [("a", 0.5, 'say "x", twice'), ("b", None, None), ("c", 1e-300, "two\nlines")]
    got = export_csv(spark.createDataFrame(first, kind), str(tmp_path), "one")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(first, key=str)
    export_csv(spark.createDataFrame([("d", 1.0, "x")], kind), str(tmp_path), "two")

    def read(name):
        return sorted(map(tuple, spark.read.schema(kind).options(header=True, escape='"', multiLine=True).csv(f"{tmp_path}/{name}").collect()), key=str)

    assert read("latest") == [("d", 1.0, "x")] and read("snapshots/one") == sorted(first, key=str)
    with pytest.raises(AnalysisException):
        export_csv(spark.createDataFrame(first, kind), str(tmp_path), "two")
    assert read("latest") == [("d", 1.0, "x")]
