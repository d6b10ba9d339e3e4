"""Wide genotype tables (a column for each variant) as long cells: each task reads a range of column chunks, so that a million columns plan like ten."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from carrierscan.sources.bgzf import locate

CONTENTS = {"cells": "sample_id string, variant string, dosage byte", "columns": "path string, place int, variant string"}
BLOCK_COLUMNS, BATCH_CELLS = 4096, 1 << 17


@dataclass(frozen=True)
class ColumnsPartition(InputPartition):
    """Some variant columns of one row group of a file."""

    path: str
    group: int
    columns: tuple[str, ...]


def dosages(column: pa.ChunkedArray) -> pa.Array:
    """0, 1 and 2 as they are; marks of missing data and other values are null."""
    one = column.combine_chunks()
    if pa.types.is_string(one.type) or pa.types.is_large_string(one.type):
        text = pc.utf8_trim_whitespace(one)
        one = pc.cast(pc.if_else(pc.match_substring_regex(text, r"^[0-9]+(\.0*)?$"), text, pa.scalar(None, text.type)), pa.float64())
    values = pc.cast(one, pa.float64())
    held = pc.and_(pc.greater_equal(values, 0.0), pc.less_equal(values, 2.0))
    return pc.cast(pc.trunc(pc.if_else(held, values, pa.scalar(None, pa.float64()))), pa.int8())


class WideReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.id_col, self.content = options["path"], options.get("idcol", "id"), options.get("content", "cells")
        self.block = int(options.get("blockcolumns", BLOCK_COLUMNS))
        self.other = set(filter(None, options.get("notvariants", "").split("\t")))
        wanted = options.get("variants")
        self.wanted = None if wanted is None else set(wanted.split("\t"))

    def files(self) -> list[str]:
        store, place = locate(self.path)
        if store.get_file_info(place).type == fs.FileType.File:
            return [self.path]
        head = self.path[: len(self.path) - len(place)] if "://" in self.path else ""
        return sorted(head + x.path for x in store.get_file_info(fs.FileSelector(place, recursive=True)) if x.path.endswith(".parquet") and x.base_name[:1] not in "_.")

    def partitions(self) -> list[ColumnsPartition]:
        """A task for each row group and block of columns; only the footers are read here."""
        out = []
        for path in self.files():
            store, place = locate(path)
            footer = pq.read_metadata(place, filesystem=store)
            names = [n for n in footer.schema.to_arrow_schema().names if n != self.id_col and n not in self.other and (self.wanted is None or n in self.wanted)]
            groups = range(footer.num_row_groups) if self.content == "cells" else [0]
            out += [ColumnsPartition(path, g, tuple(names[at : at + self.block])) for g in groups for at in range(0, len(names), self.block)]
        return out or [ColumnsPartition("", 0, ())]

    def read(self, partition: ColumnsPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, place = locate(partition.path)
        with store.open_input_file(place) as f:
            file = pq.ParquetFile(f)
            if self.content == "columns":
                at = {n: i for i, n in enumerate(file.schema_arrow.names)}
                n = len(partition.columns)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([at[c] for c in partition.columns], pa.int32()), pa.array(partition.columns, pa.string())], names=["path", "place", "variant"])
                return
            ids = pc.cast(file.read_row_group(partition.group, columns=[self.id_col]).column(0), pa.string()).combine_chunks()
            few = max(1, BATCH_CELLS // max(1, len(ids)))
            for at in range(0, len(partition.columns), few):
                names = partition.columns[at : at + few]
                table = file.read_row_group(partition.group, columns=list(names))
                for k in range(0, len(ids), BATCH_CELLS):
                    part = ids.slice(k, BATCH_CELLS)
                    values = pa.concat_arrays([dosages(table.column(c).slice(k, BATCH_CELLS)) for c in names])
                    rows = pa.array(np.tile(np.arange(len(part)), len(names)))
                    labels = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), len(part))))
                    yield pa.RecordBatch.from_arrays([part.take(rows), labels, values], names=["sample_id", "variant", "dosage"])


class WideSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wide_genotypes"

    def schema(self) -> str:
        return CONTENTS[self.options.get("content", "cells")]

    def reader(self, schema) -> WideReader:
        return WideReader(self.options)


def _load(spark: SparkSession, path: str, content: str, id_col: str, not_variants: list[str], block_columns: int, variants: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(WideSource)
    options = {"content": content, "idcol": id_col, "notvariants": "\t".join(not_variants), "blockcolumns": str(block_columns)} | ({} if variants is None else {"variants": "\t".join(variants)})
    return spark.read.format("wide_genotypes").options(**options).load(path)


def read_wide(spark: SparkSession, path: str, id_col: str = "id", variants: list[str] | None = None, not_variants: list[str] | None = None, block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """``sample_id, variant, dosage`` of the Parquet files below ``path``: all columns but the id and ``not_variants``, or ``variants`` alone where given.

    Marks of missing data (null, ``.``, -1, NaN) and values that are no dosage are null cells. A task holds one row group's cells of few columns. Wanted variants that no file
    has give no cells: see ``missing_variants``.
    """
    return _load(spark, path, "cells", id_col, not_variants or [], block_columns, variants)


def wide_columns(spark: SparkSession, path: str, id_col: str = "id", not_variants: list[str] | None = None) -> DataFrame:
    """``path, place, variant`` of every variant column, from footers alone."""
    return _load(spark, path, "columns", id_col, not_variants or [], BLOCK_COLUMNS)


def missing_variants(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """Wanted ``variant`` labels that no file has."""
    return wanted.select("variant").distinct().join(wide_columns(spark, path, id_col).select("variant").distinct(), "variant", "left_anti")
