"""Pruning of correlated variants: correlations from blocks of variants and slices of samples, then the ordered greedy pass over edges in blocks that hand their state on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.operators.order import ranked
from carrierscan.shared import write_shared

#: Variants that a task owns, and samples of one slice: a task holds the cells of a block, the window after it, and one slice.
BLOCK_VARIANTS, SLICE_SAMPLES = 256, 16_384


def indexed(geno: DataFrame, chrom: str, pos: str) -> tuple[DataFrame, DataFrame]:
    """Variants with their index on the chromosome (from 0, by position, then label), called cells and sums; and cells with that index and the sample's number."""
    per = geno.groupBy(chrom, pos, "variant").agg(F.count("dosage").alias("n"), F.sum(F.col("dosage").cast("long")).alias("x"), F.sum(F.col("dosage").cast("long") * F.col("dosage")).alias("xx"))
    places = ranked(per, [F.struct(pos, "variant")], [chrom], "_idx").withColumn("idx", F.col("_idx") - 1).drop("_idx", "_range")
    places = write_shared(places, "variants")
    samples = ranked(geno.select("sample_id").distinct(), [F.col("sample_id")], out="s").select("sample_id", (F.col("s") - 1).alias("s"))
    cells = geno.where(F.col("dosage").isNotNull()).join(places.select(chrom, pos, "variant", "idx"), [chrom, pos, "variant"]).join(samples, "sample_id").select(F.col(chrom).alias("chrom"), "idx", "s", F.col("dosage").cast("byte").alias("d"))
    return places, cells


def edges(places: DataFrame, cells: DataFrame, chrom: str, window: int, r2: float, block: int = BLOCK_VARIANTS, slice_samples: int = SLICE_SAMPLES) -> DataFrame:
    """``chrom, i, j`` with ``i < j < i + window`` whose squared correlation, missing cells at the variant's mean, is above ``r2``.

    A block meets the window after it in one slice of samples; whole-number sums of pairs are added up over slices.
    """
    own = F.floor(F.col("idx") / block)
    sent = cells.select("*", own.alias("own"), F.explode(F.array_distinct(F.array(own, F.floor((F.col("idx") - (window - 1)) / block)))).alias("b"), F.floor(F.col("s") / slice_samples).alias("slice")).where("b >= 0")

    def sums(table: pa.Table) -> pa.Table:
        idx, s, d = (table.column(c).to_numpy() for c in ("idx", "s", "d"))
        b = table.column("b")[0].as_py()
        rows, at = np.unique(idx, return_inverse=True)
        _, col = np.unique(s, return_inverse=True)
        x, known = np.zeros((len(rows), col.max(initial=-1) + 1), np.float32), np.zeros((len(rows), col.max(initial=-1) + 1), np.float32)
        x[at, col], known[at, col] = d, 1
        mine = np.flatnonzero(rows // block == b)
        out = [np.zeros(0, np.int64)] * 6
        if len(mine):
            near = np.argwhere((rows[mine][:, None] < rows[None]) & (rows[None] < rows[mine][:, None] + window))
            i, j = mine[near[:, 0]], near[:, 1]
            # Whole numbers up to four for each of the slice's samples: exact in single precision.
            both, xi, xj, xy = (m[near[:, 0], j] for m in (known[mine] @ known.T, x[mine] @ known.T, known[mine] @ x.T, x[mine] @ x.T))
            out = [rows[i], rows[j], *(v.astype(np.int64) for v in (both, xi, xj, xy))]
        first = table.column("chrom")[0].as_py()
        return pa.table({"chrom": pa.array([first] * len(out[0]), table.schema.field("chrom").type)} | dict(zip(("i", "j", "n", "x", "y", "xy"), out, strict=True)))

    kind = cells.schema["chrom"].dataType.simpleString()
    partial = sent.groupBy("chrom", "b", "slice").applyInArrow(sums, f"chrom {kind}, i long, j long, n long, x long, y long, xy long")
    both = partial.groupBy("chrom", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy")])
    side = lambda k: places.select(F.col(chrom).alias("chrom"), F.col("idx").alias(k), (F.col("x") / F.col("n")).alias(f"m{k}"), (F.col("xx") - F.col("x") * F.col("x") / F.col("n")).alias(f"v{k}"))
    found = both.join(side("i"), ["chrom", "i"]).join(side("j"), ["chrom", "j"])
    cov = F.col("xy") - F.col("mj") * F.col("x") - F.col("mi") * F.col("y") + F.col("n") * F.col("mi") * F.col("mj")
    return found.where((F.col("vi") > 0) & (F.col("vj") > 0) & (cov * cov > r2 * F.col("vi") * F.col("vj"))).select("chrom", "i", "j")


def greedy(edges: DataFrame, step: int, window: int, block: int = BLOCK_VARIANTS) -> DataFrame:
    """``chrom, idx`` of variants dropped by the pass over ``chrom, i, j, loser``: window by window, and in a window pair by pair, of two kept ones the loser goes.

    A pair is met in the first window that has both ends. Windows that begin in one block are one group's; what a block needs of those before it is which variants of its first window
    are gone, so blocks run side by side, each with what its predecessor handed on in the last round, until no block hands on anything else. Then every block has run with its true
    state. Influence ends soon where variants far apart are unrelated; at worst there are as many rounds as blocks.
    """
    met = F.greatest(F.lit(0), F.ceil((F.col("j") - (window - 1)) / step)) * step
    kind = edges.schema["chrom"].dataType.simpleString()
    # A pair that no window holds is never met.
    work = write_shared(edges.select("chrom", met.cast("long").alias("w"), "i", "j", "loser", F.floor(met / block).cast("long").alias("b")).where("w <= i"), "edges")
    spark = edges.sparkSession
    empty = spark.createDataFrame([], f"chrom {kind}, b long, gone array<long>")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = set(right.column("gone")[0].as_py()) if right.num_rows else set()
        source = left if left.num_rows else right
        b, name = source.column("b")[0].as_py(), source.column("chrom")[0].as_py()
        left = left.sort_by([("w", "ascending"), ("i", "ascending"), ("j", "ascending")])
        before = set(gone)
        for i, j, loser in zip(*(left.column(c).to_pylist() for c in ("i", "j", "loser")), strict=True):
            if i not in gone and j not in gone:
                gone.add(loser)
        handed = sorted(v for v in gone if v >= (b + 1) * block)
        columns = {"chrom": pa.array([name], source.schema.field("chrom").type), "b": pa.array([b], pa.int64()), "dropped": pa.array([sorted(gone - before)], pa.list_(pa.int64())), "handed": pa.array([handed], pa.list_(pa.int64()))}
        return pa.table(columns)

    handed = empty
    while True:
        found = write_shared(work.groupBy("chrom", "b").cogroup(handed.groupBy("chrom", "b")).applyInArrow(run, f"chrom {kind}, b long, dropped array<long>, handed array<long>"), "pass")
        after = found.where(F.size("handed") > 0).select("chrom", (F.col("b") + 1).alias("b"), F.col("handed").alias("gone"))
        if not after.exceptAll(handed).head(1) and not handed.exceptAll(after).head(1):
            return found.select("chrom", F.explode("dropped").alias("idx")).distinct()
        handed = after


def ld_prune(geno: DataFrame, window: int = 50, step: int = 5, r2: float = 0.5, chrom: str = "chrom", pos: str = "pos", block: int = BLOCK_VARIANTS, slice_samples: int = SLICE_SAMPLES) -> DataFrame:
    """``chrom, pos, variant, maf`` of the variants that sliding-window pruning keeps: of two kept variants in a window with squared correlation above ``r2`` the rarer goes, the later one of equals.

    Windows of ``window`` variants begin at every ``step``-th. Variants without a called cell or without variance go. The published definition, not another program's tie rules. No task
    holds a chromosome: see ``edges`` and ``greedy``.
    """
    if block < window:
        raise ValueError("a block holds a window at least")
    places, cells = indexed(geno, chrom, pos)
    share = F.col("x") / F.col("n") / 2
    rare = places.select(F.col(chrom).alias("chrom"), "idx", F.least(share, 1 - share).alias("maf"))
    found = edges(places, cells, chrom, window, r2, block, slice_samples)
    both = found.join(rare.select("chrom", F.col("idx").alias("i"), F.col("maf").alias("a")), ["chrom", "i"]).join(rare.select("chrom", F.col("idx").alias("j"), F.col("maf").alias("b")), ["chrom", "j"])
    gone = greedy(both.select("chrom", "i", "j", F.when(F.col("a") < F.col("b"), F.col("i")).otherwise(F.col("j")).alias("loser")), step, window, block)
    varied = places.where((F.col("n") > 0) & (F.col("xx") * F.col("n") > F.col("x") * F.col("x")))
    kept = varied.join(gone.select(F.col("chrom").alias(chrom), "idx"), [chrom, "idx"], "left_anti")
    return kept.select(chrom, pos, "variant", F.least(share, 1 - share).alias("maf"))


#: Variants whose products with each other are one matrix on the driver at most (8 bytes for each pair), and entries of a task's block of samples.
FEW_VARIANTS, BLOCK_ENTRIES = 2048, 1 << 22


def _few_variants(known: DataFrame, people: DataFrame, components: int) -> DataFrame | None:
    """The components by way of the variants' products with each other: blocks of samples give them, the driver gets variants times variants, and samples' entries stay on the cluster.

    None where there are more than ``FEW_VARIANTS``, or fewer components than wanted have an eigenvalue.
    """
    spark = known.sparkSession
    per = known.groupBy("variant").agg((F.avg("dosage") / 2).alias("p")).where("p > 0 and p < 1")
    loci = write_shared(ranked(per, [F.col("variant")], out="_v").select("variant", "p", (F.col("_v") - 1).cast("int").alias("v")), "loci")
    m = loci.count()
    if not components or m > FEW_VARIANTS or m < components:
        return None
    block = max(256, BLOCK_ENTRIES // m)
    z = (F.col("dosage") - 2 * F.col("p")) / F.sqrt(2 * F.col("p") * (1 - F.col("p")))
    cells = write_shared(known.join(F.broadcast(loci), "variant").groupBy("s").agg(F.collect_list("v").alias("v"), F.collect_list(z).alias("z")).withColumn("b", F.floor(F.col("s") / block)).repartition("b"), "standardised")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = np.zeros((part.num_rows, m))
                x[np.repeat(np.arange(part.num_rows), part.column("v").value_lengths().to_numpy()), part.column("v").flatten().to_numpy()] = part.column("z").flatten().to_numpy()
                yield part.column("s").to_numpy(), x

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for _, x in blocks(batches):
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array([r.tobytes() for r in total], pa.binary())], names=["at", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"at": table.column("at").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    got = cells.mapInArrow(products, "at long, sums binary").groupBy("at").applyInArrow(added, "at long, sums binary").orderBy("at").toArrow()
    if got.num_rows < m:
        return None
    values, turn = np.linalg.eigh(np.frombuffer(b"".join(got.column("sums").to_pylist())).reshape(m, m))
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    if values[-1] <= 1e-9 * values[0]:
        return None
    turn = turn / np.sqrt(values)
    names = [f"pc{i + 1}" for i in range(components)]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, x in blocks(batches):
            y = x @ turn
            yield pa.RecordBatch.from_arrays([pa.array(s), *(pa.array(np.ascontiguousarray(c)) for c in y.T)], names=["s", *names])

    rows = write_shared(cells.mapInArrow(entries, ", ".join(["s int", *(f"{c} double" for c in names)])), "components")
    largest = rows.agg(*[F.max_by(c, F.struct(F.abs(c), -F.col("s"))).alias(c) for c in names]).head()
    signed = rows.select("s", *[(F.col(c) * (1.0 if largest[c] >= 0 else -1.0)).alias(c) for c in names])
    return people.join(signed, "s", "left").na.fill(0.0, names).drop("s")


def principal_components(geno: DataFrame, components: int = 10, extra: int = 10, most_rounds: int = 60, tolerance: float = 1e-9, seed: int = 42) -> DataFrame:
    """``sample_id, pc1 ...``: leading eigenvectors of the samples' relationship over standardised dosages, by randomised subspace iteration.

    Variants are rows of whole-number dosages, written once. Each round multiplies them, block by block, with a basis of samples by ``components + extra`` columns and back; tasks' products are added up
    by sample block, and the driver orthogonalises the sum. So tasks and driver hold 8 bytes for each sample and column of the basis, and no matrix of samples by samples exists. Rounds end when the
    wanted eigenvalues and vectors stand still, or after ``most_rounds``. Up to ``FEW_VARIANTS`` need no rounds: see ``_few_variants``. Missing cells count as the mean; variants without variance or called cells take no part. Each component's largest entry is positive.
    """
    spark = geno.sparkSession
    people = write_shared(ranked(geno.select("sample_id").distinct(), [F.col("sample_id")], out="s").select("sample_id", (F.col("s") - 1).cast("int").alias("s")), "people")
    n = people.count()
    known = geno.where(F.col("dosage").isNotNull()).join(people, "sample_id")
    rows = write_shared(known.groupBy("variant").agg(F.collect_list("s").alias("s"), F.collect_list(F.col("dosage").cast("byte")).alias("d")).select("s", "d"), "rows")
    width = min(n, components + extra)
    few = _few_variants(known, people, min(components, n))
    if few is not None:
        return few

    def times(basis):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, used = np.zeros((n, width)), 0
            for batch in batches:
                step = max(1, (1 << 22) // max(1, n))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    s, d = (part.column(c).flatten().to_numpy() for c in ("s", "d"))
                    row = np.repeat(np.arange(part.num_rows), part.column("s").value_lengths().to_numpy())
                    called = np.bincount(row, minlength=part.num_rows)
                    p = np.bincount(row, d, part.num_rows) / called / 2
                    good = (p > 0) & (p < 1)
                    x = np.zeros((part.num_rows, n))
                    x[row, s] = ((d - 2 * p[row]) / np.sqrt(np.where(good, 2 * p * (1 - p), 1))[row]) * good[row]
                    total += x.T @ (x @ basis.value)
                    used += int(good.sum())
            if used:
                at = np.arange(0, n, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[a : a + 4096].tobytes() for a in at], pa.binary())], names=["at", "sums"])

        return run

    def added(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"at": table.column("at").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0] if n else np.zeros((0, 0))
    values, top = np.zeros(0), np.zeros((n, 0))
    for _ in range(most_rounds if n else 0):
        shared = spark.sparkContext.broadcast(q)
        got = rows.mapInArrow(times(shared), "at long, sums binary").groupBy("at").applyInArrow(added, "at long, sums binary").orderBy("at").toArrow()
        shared.destroy()
        if not got.num_rows:
            break
        y = np.frombuffer(b"".join(got.column("sums").to_pylist())).reshape(n, width)
        small, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        order = np.argsort(-small)[:components]
        found, vectors = small[order], q @ turn[:, order]
        still = len(values) and np.abs(found - values).max() <= tolerance * max(found[0], 1e-300) and 1 - np.abs((vectors * top).sum(axis=0)).min() <= tolerance
        values, top = found, vectors
        if still:
            break
        q = np.linalg.qr(y)[0]
    if top.shape[1]:
        top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    schema = ", ".join(["s int", *(f"pc{i + 1} double" for i in range(top.shape[1]))])
    table = pa.table({"s": pa.array(np.arange(len(top)), pa.int32())} | {f"pc{i + 1}": pa.array(np.ascontiguousarray(top[:, i])) for i in range(top.shape[1])})
    return people.join(spark.createDataFrame(table, schema), "s").drop("s")
