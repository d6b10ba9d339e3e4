"""Result tables that survive restarts: append-only Parquet under a path that names the settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.config import StudyConfig
from carrierscan.operators.cohorts import latest


class ResultStore:
    """Batches of results by key. A changed setting has another fingerprint, so it never meets old rows."""

    def __init__(self, spark: SparkSession, root: str, name: str, config: StudyConfig, key: list[str]):
        self.spark, self.key = spark, key
        self.path = f"{root.rstrip('/')}/{name}/{config.fingerprint(name)}"

    def read(self) -> DataFrame | None:
        """The newest row of each key, or none before the first batch."""
        try:
            return latest(self.spark.read.parquet(self.path), self.key, "batch")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def append(self, rows: DataFrame, batch: int) -> None:
        """One batch, all or nothing by Spark's committer."""
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(self.path)

    def pending(self, universe: DataFrame) -> DataFrame:
        """Keys without a finished row; failed ones come again."""
        done = self.read()
        return universe if done is None else universe.join(done.where("status = 'done'"), self.key, "left_anti")

    def resume(self, universe: DataFrame, work: Callable[[DataFrame], DataFrame], batch: int) -> DataFrame:
        """Run what is pending, append it, and give all results."""
        todo = self.pending(universe)
        if todo.head(1):
            self.append(work(todo), batch)
        return self.read()


def without_orphans(downstream: DataFrame, candidates: DataFrame, key: str = "variant") -> DataFrame:
    """Rows of later stages whose variant is still a candidate."""
    return downstream.join(candidates.select(key).distinct(), key, "left_semi")


def export_csv(rows: DataFrame, folder: str, stamp: str) -> DataFrame:
    """Write ``rows`` as CSV with a header to ``snapshots/<stamp>`` below ``folder``, then as ``latest``; gives the snapshot's rows.

    The work runs once: ``latest`` is a copy of the snapshot. An existing snapshot of that stamp is an error, and stays as it is. Nulls are empty fields, empty texts quoted.
    """
    options = {"header": True, "emptyValue": '""', "escape": '"'}
    snapshot = f"{folder.rstrip('/')}/snapshots/{stamp}"
    rows.write.options(**options).csv(snapshot)
    kept = rows.sparkSession.read.schema(rows.schema).options(header=True, escape='"', multiLine=True).csv(snapshot)
    kept.write.mode("overwrite").options(**options).csv(f"{folder.rstrip('/')}/latest")
    return kept
