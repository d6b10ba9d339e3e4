"""A store of genotypes: dosages of all samples as one array for each variant, by chromosome and position, under a path that names the settings that made it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.operators.order import ranked
from carrierscan.shared import exists, remove

#: Rows of variants that one sorted range of a chromosome's files gets, about.
VARIANTS_A_FILE = 20_000


class GenotypeStore:
    """Cells ``sample_id, variant, chrom, pos, dosage`` as ``variant, pos, dosages`` (of all samples by ``place``, null where none is called) below ``chrom=...``, and ``sample_id, place``.
    Of repeated cells the smallest dosage stays.

    Settings that differ have another fingerprint and so another path: old data is never read under new settings. Written parts count once a manifest
    says that all are there; without one, or with ``force``, the store is made anew.
    """

    def __init__(self, spark: SparkSession, root: str, settings: dict):
        self.spark = spark
        self.fingerprint = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.path = f"{root.rstrip('/')}/genotypes-{self.fingerprint}"

    def ready(self) -> bool:
        return exists(self.spark, f"{self.path}/manifest/_SUCCESS")

    def get_or_build(self, make: Callable[[], DataFrame], force: bool = False) -> GenotypeStore:
        """Build the store from the cells that ``make`` gives, unless it is there."""
        if force or not self.ready():
            self._build(make())
        return self

    def _build(self, cells: DataFrame) -> None:
        remove(self.spark, self.path)
        people = ranked(cells.select("sample_id").distinct(), [F.col("sample_id")], out="place").select("sample_id", (F.col("place") - 1).cast("int").alias("place"))
        people.write.parquet(f"{self.path}/samples")
        people = self.samples()
        n = people.count()
        pairs = cells.join(people, "sample_id").select(*[F.col(c).cast(t).alias(c) for c, t in (("chrom", "string"), ("pos", "long"), ("variant", "string"))], "place", F.col("dosage").cast("byte").alias("dosage"))
        # collect_list drops null structs only, and collect_list of a null dosage nothing at all: a variant without a called cell keeps its row.
        known = F.collect_list(F.when(F.col("dosage").isNotNull(), F.struct("place", "dosage")))
        all_rows = pairs.groupBy("chrom", "pos", "variant").agg(F.array_sort(known).alias("_pairs")).select("chrom", "pos", "variant", F.col("_pairs.place").alias("place"), F.col("_pairs.dosage").alias("dosage")).mapInArrow(lambda batches: _dense(batches, n), "chrom string, pos long, variant string, dosages array<tinyint>")
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        spread = all_rows.repartitionByRange(parts, "chrom", "pos", "variant").sortWithinPartitions("chrom", "pos", "variant")
        spread.write.option("maxRecordsPerFile", VARIANTS_A_FILE).option("compression", "zstd").partitionBy("chrom").parquet(f"{self.path}/variants")
        counts = self.variants().agg(F.count(F.lit(1)).alias("variants"), F.countDistinct("chrom").alias("chroms")).withColumns({"samples": F.lit(n), "fingerprint": F.lit(self.fingerprint)})
        counts.write.parquet(f"{self.path}/manifest")

    def samples(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/samples").schema).parquet(f"{self.path}/samples")

    def variants(self, chroms: list[str] | None = None, first: int | None = None, last: int | None = None, labels: list[str] | None = None) -> DataFrame:
        """``chrom, pos, variant, dosages``; only folders of wanted chromosomes are read, and files' statistics leave out other positions."""
        rows = self.spark.read.schema("variant string, pos long, dosages array<tinyint>, chrom string").parquet(f"{self.path}/variants")
        if chroms is not None:
            rows = rows.where(F.col("chrom").isin(chroms))
        if first is not None:
            rows = rows.where(F.col("pos") >= first)
        if last is not None:
            rows = rows.where(F.col("pos") <= last)
        if labels is not None:
            rows = rows.where(F.col("variant").isin(labels))
        return rows.select("chrom", "pos", "variant", "dosages")

    def cells(self, **wanted) -> DataFrame:
        """Long cells of wanted variants, one for each sample."""
        rows = self.variants(**wanted).select("chrom", "pos", "variant", F.posexplode("dosages").alias("place", "dosage"))
        return rows.join(self.samples(), "place").select("sample_id", "chrom", "pos", "variant", "dosage")


def _dense(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sorted places and dosages of each variant as an array of all ``n`` samples; the first of a place's dosages stays."""
    for batch in batches:
        rows = np.full((batch.num_rows, n), -1, np.int8)
        for i in range(batch.num_rows):
            at, value = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("place", "dosage"))
            rows[i, at[::-1]] = value[::-1]
        flat = rows.reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), pa.array(flat, pa.int8(), mask=flat < 0))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chrom", "pos", "variant")), lists], names=["chrom", "pos", "variant", "dosages"])
