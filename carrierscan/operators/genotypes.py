"""Genotype quality over long genotypes ``sample_id, variant, dosage``: one row per cell, null or absent when missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.functions import expressions as X
from carrierscan.operators.order import ranked
from carrierscan.shared import write_shared


def densify(samples: DataFrame, variants: DataFrame, carried: DataFrame) -> DataFrame:
    """One cell for each sample and variant; pairs that ``carried`` lacks have dosage 0."""
    cells = samples.select("sample_id").crossJoin(variants.select("variant"))
    return cells.join(carried, ["sample_id", "variant"], "left").withColumn("dosage", F.coalesce("dosage", F.lit(0)))


def drop_prefixed_samples(geno: DataFrame, prefixes: list[str]) -> DataFrame:
    for p in prefixes:
        geno = geno.where(~F.startswith(F.col("sample_id").cast("string"), F.lit(p)))
    return geno


def allele_frequency(geno: DataFrame, samples: int | None = None) -> DataFrame:
    """Per variant: called cells, frequency, folded frequency, carrier frequency, call rate (of ``samples``, or of the rows)."""
    called = F.count("dosage")
    p = F.avg("dosage") / 2
    total = F.count(F.lit(1)) if samples is None else F.lit(samples)
    return geno.groupBy("variant").agg(
        called.alias("n_called"), p.alias("alt_freq"), F.least(p, 1 - p).alias("maf"), F.avg(F.when(F.col("dosage") > 0, 1.0).when(F.col("dosage") == 0, 0.0)).alias("carrier_freq"), (called / total).alias("call_rate"), F.var_samp("dosage").alias("variance")
    )


def keep_frequent(geno: DataFrame, least_maf: float) -> DataFrame:
    """Variants of at least the folded frequency, found by one partial aggregate and a semi-join on it."""
    return geno.join(allele_frequency(geno).where(F.col("maf") >= least_maf).select("variant"), "variant", "left_semi")


def keep_called(geno: DataFrame, samples: DataFrame, most_missing: float) -> DataFrame:
    """Variants with a share of missing cells below ``most_missing``; absent pairs are missing, so samples give the denominator."""
    n = samples.select("sample_id").distinct().count()
    good = geno.groupBy("variant").agg(F.countDistinct(F.when(F.col("dosage").isNotNull(), F.col("sample_id"))).alias("n")).where(1 - F.col("n") / F.lit(n) < most_missing)
    return geno.join(good.select("variant"), "variant", "left_semi")


def sequential_missingness(geno: DataFrame, most_variant: float = 0.05, most_sample: float = 0.05) -> DataFrame:
    """Variant missingness first, sample missingness on what is left: the order matters."""
    rate = F.avg(F.col("dosage").isNull().cast("double"))
    variants = geno.groupBy("variant").agg(rate.alias("f_miss")).where(F.col("f_miss") <= most_variant)
    left = geno.join(variants.select("variant"), "variant", "left_semi")
    people = left.groupBy("sample_id").agg(rate.alias("f_miss")).where(F.col("f_miss") <= most_sample)
    return left.join(people.select("sample_id"), "sample_id", "left_semi")


def biallelic_snps(sites: DataFrame) -> DataFrame:
    """Sites with one alternative, all alleles of one letter."""
    return sites.where((F.size("alts") == 1) & (F.length("ref") == 1) & (F.length(F.get("alts", F.lit(0))) == 1))


def fill_missing(strategy: str) -> Column:
    """``zero`` fills missing dosages with 0, ``nan`` keeps them null; both give carriers afterwards."""
    if strategy not in ("zero", "nan"):
        raise ValueError("strategy is zero or nan")
    return X.carrier(F.coalesce("dosage", F.lit(0)) if strategy == "zero" else F.col("dosage"))


def merge_batches(batches: list[DataFrame]) -> DataFrame:
    """Union of batches; of cells that several batches hold, the first batch's stays."""
    rows = None
    for order, batch in enumerate(batches):
        one = batch.select("sample_id", "variant", "dosage", F.lit(order).alias("_batch"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("sample_id", "variant").agg(F.min(F.struct("_batch", "dosage")).alias("_first")).select("sample_id", "variant", F.col("_first.dosage").alias("dosage"))


def drop_monomorphic(geno: DataFrame) -> DataFrame:
    return geno.join(geno.groupBy("variant").agg(F.var_samp("dosage").alias("v")).where("v > 0").select("variant"), "variant", "left_semi")


def heterozygosity(geno: DataFrame) -> DataFrame:
    """``F = (observed - expected) / (n - expected)`` homozygotes of each sample over called cells."""
    p = F.avg("dosage").over(Window.partitionBy("variant")) / 2
    n = F.count("dosage").over(Window.partitionBy("variant"))
    rows = geno.where(F.col("dosage").isNotNull()).withColumns({"_p": p, "_n": n}).where("_n > 1")
    expected = 1 - 2 * F.col("_p") * (1 - F.col("_p")) * 2 * F.col("_n") / (2 * F.col("_n") - 1)
    sums = rows.groupBy("sample_id").agg(F.sum(F.col("dosage").isin(0, 2).cast("double")).alias("o_hom"), F.sum(expected).alias("e_hom"), F.count(F.lit(1)).alias("n_sites"))
    return sums.withColumn("f", F.try_divide(F.col("o_hom") - F.col("e_hom"), F.col("n_sites") - F.col("e_hom")))


def king_kinship(geno: DataFrame, block: int = 1024, slice_variants: int = 4096) -> DataFrame:
    """KING-robust kinship of every pair of samples, ``id1 < id2``, as sums over variants that both have.

    A sample's cells of one slice of variants are packed into a row. Samples go to blocks, and a task takes two blocks slice by slice, adding up whole-number counts of
    their pairs. So only packed rows move, once for each pair of blocks, and pairs are never shuffled; ``block`` and ``slice_variants`` bound a task's memory. All pairs are
    the square of the samples by nature.
    """
    spark = geno.sparkSession
    kind = geno.schema["sample_id"].dataType.simpleString()
    loci = write_shared(ranked(geno.select("variant").distinct(), [F.col("variant")], out="_p").select("variant", F.floor((F.col("_p") - 1) / slice_variants).cast("int").alias("slice"), F.pmod(F.col("_p") - 1, F.lit(slice_variants)).cast("int").alias("_at")), "loci")
    # Of repeated cells the largest counts.
    cells = geno.where(F.col("dosage").isNotNull()).join(loci, "variant").groupBy("sample_id", "slice", "_at").agg(F.max("dosage").cast("byte").alias("_d"))
    packed = write_shared(cells.groupBy("sample_id", "slice").agg(F.collect_list("_at").alias("at"), F.collect_list("_d").alias("d")), "packed")
    count = max(1, -(-packed.select("sample_id").distinct().count() // block))
    of = F.pmod(F.xxhash64("sample_id"), F.lit(count)).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(F.least(of, k).alias("a"), F.greatest(of, k).alias("b")))).alias("cell")
    dealt = packed.select("sample_id", "slice", "at", "d", of.alias("_b"), pairs).select("sample_id", "slice", "at", "d", "_b", "cell.a", "cell.b")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(count * (count + 1) // 2, 4096))
    dealt = dealt.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: _PairSums | None = None
        for batch in batches:
            a, b, s = (batch.column(c).to_numpy() for c in ("a", "b", "slice"))
            ends = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(s) != 0)) + 1
            for start, end in zip([0, *ends], [*ends, batch.num_rows], strict=True) if batch.num_rows else ():
                if sums is not None and sums.key != (a[start], b[start]):
                    yield from sums.rows(kind_of)
                    sums = None
                sums = sums or _PairSums((a[start], b[start]), slice_variants)
                sums.take(int(s[start]), batch.slice(start, end - start))
        if sums is not None:
            yield from sums.rows(kind_of)

    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    found = dealt.mapInArrow(run, f"id1 {kind}, id2 {kind}, n_snp long, het_het long, ibs0 long, h1 long, h2 long")
    low = F.least("h1", "h2")
    phi = (F.col("het_het") - 2 * F.col("ibs0")) / (2 * low) + 0.5 - (F.col("h1") + F.col("h2")) / (4 * low)
    return found.select("id1", "id2", "n_snp", "het_het", "ibs0", F.when(low > 0, phi).alias("kinship"))


class _PairSums:
    """Counts of the pairs of two blocks ``key``, added up over slices of ``width`` variants that come one after the other."""

    def __init__(self, key: tuple[int, int], width: int):
        self.key, self.width = key, width
        self.ids: tuple[dict, dict] = ({}, {})
        self.counts = np.zeros((5, 0, 0), np.int64)
        self.slice, self.parts = None, []

    def take(self, number: int, part: pa.RecordBatch) -> None:
        if self.slice != number:
            self.add()
        self.slice = number
        self.parts.append(part)

    def add(self) -> None:
        """Add the slice's products."""
        if not self.parts:
            return
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        own, ids = table.column("_b").to_numpy(), table.column("sample_id").to_pylist()
        at, d = (table.column(c).combine_chunks() for c in ("at", "d"))
        row = np.repeat(np.arange(len(ids)), at.value_lengths().to_numpy())
        value = np.full((len(ids), self.width), -1, np.int8)
        value[row, at.flatten().to_numpy()] = d.flatten().to_numpy()
        value = value[:, (value >= 0).any(axis=0)]
        sides = []
        for known, block in zip(self.ids, self.key, strict=True):
            mine = np.flatnonzero(own == block)
            sides.append((np.array([known.setdefault(ids[i], len(known)) for i in mine], np.int64), value[mine]))
        shape = (len(self.ids[0]), len(self.ids[1]))
        if self.counts.shape[1:] != shape:
            grown = np.zeros((5, *shape), np.int64)
            grown[:, : self.counts.shape[1], : self.counts.shape[2]] = self.counts
            self.counts = grown
        (i, x), (j, y) = sides
        # Counts up to a slice's variants are exact in single precision.
        flag = lambda m: m.astype(np.float32)
        known, het, zero, two = zip(*[(flag(m >= 0), flag(m == 1), flag(m == 0), flag(m == 2)) for m in (x, y)], strict=True)
        products = (known[0] @ known[1].T, het[0] @ het[1].T, zero[0] @ two[1].T + two[0] @ zero[1].T, het[0] @ known[1].T, known[0] @ het[1].T)
        for total, product in zip(self.counts, products, strict=True):
            total[np.ix_(i, j)] += product.astype(np.int64)

    def rows(self, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        """Pairs with a common variant, the smaller id first, some rows of the first block at a time."""
        self.add()
        first, second = (pa.array(list(known), kind) for known in self.ids)
        if not len(first) or not len(second):
            return
        order = {x: k for k, x in enumerate(sorted({*self.ids[0], *self.ids[1]}))}
        one, two = (np.array([order[x] for x in known]) for known in self.ids)
        step = max(1, (1 << 17) // len(two))
        for start in range(0, len(one), step):
            n = self.counts[:, start : start + step]
            less = one[start : start + step, None] < two[None]
            some = n[0] > 0
            if self.key[0] == self.key[1]:
                some &= less
            i, j = np.nonzero(some)
            swap = ~less[i, j]
            x, y = first.take(pa.array(i + start)), second.take(pa.array(j))
            turn = pa.array(swap)
            n_snp, het_het, ibs0, hx, hy = (c[i, j] for c in n)
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(turn, y, x), pc.if_else(turn, x, y), *(pa.array(c) for c in (n_snp, het_het, ibs0, np.where(swap, hy, hx), np.where(swap, hx, hy)))], names=["id1", "id2", "n_snp", "het_het", "ibs0", "h1", "h2"]
            )


def ld_pairs(geno: DataFrame, reach: int, pos: str = "pos") -> DataFrame:
    """Squared correlation of variants at most ``reach`` apart in position, natively: cells of a sample meet on position blocks.

    It comes from whole-number sums over samples with both cells, so that it does not depend on the order of rows; null where a variant does not vary.
    """
    block = F.floor(F.col(pos) / reach)
    left = geno.select("sample_id", F.col("variant").alias("v1"), F.col(pos).alias("p1"), F.col("dosage").alias("d1"), block.alias("_b"))
    right = geno.select("sample_id", F.col("variant").alias("v2"), F.col(pos).alias("p2"), F.col("dosage").alias("d2"), F.explode(F.array(block, block - 1)).alias("_b"))
    near = left.join(right, ["sample_id", "_b"]).where((F.col("p1") < F.col("p2")) & (F.col("p2") - F.col("p1") <= reach) & F.col("d1").isNotNull() & F.col("d2").isNotNull())
    x, y = F.col("d1").cast("long"), F.col("d2").cast("long")
    sums = near.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    covariance, one, two = (F.expr(e).cast("double") for e in ("n * xy - x * y", "n * xx - x * x", "n * yy - y * y"))
    return sums.select("v1", "v2", F.try_divide(covariance * covariance, one * two).alias("r2"))
