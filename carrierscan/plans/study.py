"""Study tables made from the star schema: customers are samples, part sizes are variants, order values are the phenotype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.operators import genotypes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(x: Column) -> Column:
    """The mean of doubles that eight decimals write out, from their exact sum: the same in any order of rows, so that equal groups have equal means. Other values have Spark's own mean.

    Sums below 90,000,000 are divided in units of the eighth decimal, which a double holds as they are: means that are equal as fractions are equal, whatever their counts.
    """
    fixed = x.try_cast("decimal(28, 8)")
    total, n = F.sum(fixed), F.count(x)
    units = (total.try_cast("decimal(18, 8)") * F.lit(10**8).cast("decimal(9, 0)")).cast("double")
    mean = F.when(F.abs(total) < 90_000_000, F.try_divide(units, n * F.lit(1e8))).otherwise(F.try_divide(total.cast("double"), n))
    return F.when(F.bool_and(fixed.cast("double").eqNullSafe(x)), mean).otherwise(F.avg(x))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, cohort, nation, e`` (exposure) ``, y`` (phenotype) ``, n_orders``; samples without orders have a null phenotype."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(exact_mean(F.col("o_totalprice")).alias("y"), F.count(F.lit(1)).alias("n_orders"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("cohort"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("e"))
    return people.join(orders, "sample_id", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a dosage of 1 or 2: how often a customer bought parts of a size, at most twice."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample_id"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("variant"))
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey").groupBy("sample_id", "variant").agg(F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("dosage"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("variant")).distinct()


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.densify(samples(spark, sf_dir), variants(spark, sf_dir), carried(spark, sf_dir))


def sparse(spark: SparkSession, sf_dir: str, where: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Carried cells, all variants, and samples (those of ``where``): what estimators over carriers take."""
    people = samples(spark, sf_dir)
    return carried(spark, sf_dir), variants(spark, sf_dir), people.where(where) if where else people


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cells with their sample's columns and the carrier flag ``v``."""
    return dense(spark, sf_dir).join(samples(spark, sf_dir), "sample_id").withColumn("v", (F.col("dosage") > 0).cast("int"))


SQL = """
    samples AS (
        SELECT c_custkey AS sample_id, c_mktsegment AS cohort, c_nationkey AS nation, c_acctbal AS e, avg(o_totalprice) AS y, count(o_orderkey) AS n_orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
    ),
    carried AS (
        SELECT o_custkey AS sample_id, p_size AS variant, least(2, count(*)) AS dosage
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
    ),
    dense AS (
        SELECT s.sample_id, v.variant, coalesce(c.dosage, 0) AS dosage
        FROM samples s CROSS JOIN (SELECT DISTINCT p_size AS variant FROM part) v LEFT JOIN carried c ON c.sample_id = s.sample_id AND c.variant = v.variant
    ),
    analysis AS (SELECT d.*, s.* EXCLUDE (sample_id), CAST(dosage > 0 AS INTEGER) AS v FROM dense d JOIN samples s ON s.sample_id = d.sample_id)
"""
