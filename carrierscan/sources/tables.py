"""Text tables of genetics programs, toxicogenomics exports, and study files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whitespace_table(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """A white-space table whose header may begin with ``#``; all columns are text. ``aliases`` renames columns that exist."""
    lines = spark.read.text(path)
    header = lines.where(F.trim("value") != "").head(1)
    if not header:
        raise ValueError(f"{path} is empty")
    names = header[0]["value"].lstrip("#").split()
    cells = F.split(F.trim("value"), r"\s+")
    body = lines.where((F.trim("value") != "") & (F.col("value") != header[0]["value"])).select(cells.alias("c"))
    out = body.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])
    for old, new in (aliases or {}).items():
        if old in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; NaN and text that is no number become null."""
    def one(c: str) -> Column:
        value = F.col(c).try_cast("double")
        return F.when(~F.isnan(value), value)

    return df.withColumns({c: one(c) for c in columns})


def commented_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose header is the last line that begins with ``#``; short rows are filled, long rows cut."""
    lines = spark.read.text(path)
    headers = lines.where(F.col("value").startswith("#")).tail(1)
    if not headers:
        raise ValueError(f"{path} has no header")
    names = [n.strip() for n in headers[0]["value"].lstrip("#").strip().split("\t")]
    cells = F.split("value", "\t", -1)
    return lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(*[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def study_csv(spark: SparkSession, path: str, sep: str = ",", decimal: str = ".", columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header; a decimal comma becomes a point. Only ``columns`` are read when given."""
    df = spark.read.csv(path, header=True, sep=sep)
    df = df.select(*columns) if columns else df
    if decimal == ",":
        df = df.select(*[F.when(F.col(c).rlike(r"^-?\d+,\d+$"), F.regexp_replace(c, ",", ".")).otherwise(F.col(c)).alias(c) for c in df.columns])
    return df


def wide_to_long(df: DataFrame, id_col: str, not_variants: list[str]) -> DataFrame:
    """A wide genotype table as long cells, with missing marks as null."""
    from carrierscan.functions.expressions import dosage

    wanted = [c for c in df.columns if c not in {id_col, *not_variants}]
    text = df.select(F.col(id_col).alias("sample_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in wanted])
    return text.unpivot("sample_id", wanted, "variant", "raw").select("sample_id", "variant", dosage(F.col("raw")).alias("dosage"))
