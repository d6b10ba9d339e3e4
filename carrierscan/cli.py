"""Runs of a study from the command line: ``python -m carrierscan.cli variance --genotypes DIR --samples FILE --root DIR --generation gen1 --exposure e1``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.config import StudyConfig
from carrierscan.functions import expressions as X
from carrierscan.operators import statistics
from carrierscan.plans import pipelines, runs
from carrierscan.sources import tables, vcf, wide


def genotypes(spark: SparkSession, path: str, kind: str, index: str | None = None, carriers: bool = False) -> DataFrame:
    """Cells ``sample_id, variant, dosage`` from VCF files, a wide table, or long Parquet."""
    if kind == "vcf":
        cells = vcf.to_dosages(vcf.read_sites(spark, path, index=index))
    elif kind == "wide":
        cells = wide.read_wide(spark, path)
    else:
        cells = spark.read.parquet(path)
    cells = cells.select(X.clean_sample_id(F.col("sample_id").cast("string")).alias("sample_id"), "variant", "dosage")
    return cells.withColumn("dosage", X.carrier(F.col("dosage"))) if carriers else cells


def samples(spark: SparkSession, args: argparse.Namespace, config: StudyConfig) -> DataFrame:
    """The study's table with target, exposures and covariates as numbers; sex becomes 0 and 1, and a category a 0/1 column for each level but the first, on which the scan matches too."""
    rows = tables.study_csv(spark, args.samples, args.sep, args.decimal).withColumnRenamed(config.sample_id, "sample_id")
    named = [c for c in dict.fromkeys([config.target, *config.exposures, *args.covariate]) if c != "sex"]
    rows = rows.select(X.clean_sample_id(F.col("sample_id")).alias("sample_id"), *[X.number(F.col(c)).alias(c) for c in named], *([X.sex_code(F.col("sex")).alias("sex")] if "sex" in args.covariate else []), *[F.nullif(F.trim(c), F.lit(".")).alias(c) for c in args.category])
    rows, _ = statistics.dummies(rows, args.category)
    pcs = None
    if args.components:
        pcs = tables.study_csv(spark, args.components)
        pcs = pcs.select(X.clean_sample_id(F.col(pcs.columns[0])).alias("sample_id"), *[X.number(F.col(c)).alias(c) for c in pcs.columns[1 : 1 + config.components]])
    return pipelines.prepared_samples(rows, config, pcs=pcs)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> runs.Generation:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["model", "variance", "status"])
    parser.add_argument("--study", choices=["model", "variance"], default="variance", help="whose steps status lists")
    parser.add_argument("--genotypes")
    parser.add_argument("--kind", choices=["vcf", "wide", "long"], default="long")
    parser.add_argument("--index")
    parser.add_argument("--samples")
    parser.add_argument("--components", help="CSV of sample ids and components")
    parser.add_argument("--sep", default=",")
    parser.add_argument("--decimal", default=".")
    parser.add_argument("--root", required=True)
    parser.add_argument("--generation", required=True)
    parser.add_argument("--target", default="onset_age")
    parser.add_argument("--exposure", action="append", default=[])
    parser.add_argument("--covariate", action="append", default=[])
    parser.add_argument("--category", action="append", default=[], help="a text covariate")
    parser.add_argument("--setting", action="append", default=[], help="name=value of any number in the settings")
    parser.add_argument("--parts", type=int, default=runs.SCAN_PARTS)
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    given = dict(s.split("=", 1) for s in args.setting)
    numbers = {k: type(getattr(StudyConfig(), k))(float(v)) for k, v in given.items()}
    config = StudyConfig(target=args.target, exposures=tuple(args.exposure), covariates=(*args.covariate, *args.category), **numbers)
    spark = spark or SparkSession.builder.appName("carrierscan").getOrCreate()
    run = runs.Generation(spark, args.root, args.generation, config)
    if args.command == "status":
        run.status(runs.STEPS[args.study]).show(truncate=False)
        return run
    if args.force:
        run.forget()
    people = samples(spark, args, config)
    covariates = [c for c in people.columns if c not in ("sample_id", config.target, *config.exposures)]
    cells = genotypes(spark, args.genotypes, args.kind, args.index, args.command == "model")
    {"model": runs.run_model, "variance": runs.run_variance}[args.command](run, cells, people, covariates, parts=args.parts)
    return run


if __name__ == "__main__":
    main()
