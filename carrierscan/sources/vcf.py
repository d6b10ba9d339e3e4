"""VCF files as a Spark data source: ``spark.read.format("vcf").load(path)``, cut into ranges, with an index, filters and a writer.

A block-compressed or plain file is read by many tasks, each a range of bytes; a gzip file without blocks by one. With an index only ranges that may hold
wanted sites are read. Chromosomes are wanted with and without the prefix ``chr``.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from carrierscan.sources import bgzf

SITES = "path string, chrom string, pos long, ref string, alts array<string>, sample_ids array<string>, genotypes array<string>"
#: What the option ``content`` names: sites, the header's samples, or the place of each site's range.
CONTENTS = {"sites": SITES, "samples": "path string, place int, sample_id string", "ranges": "path string, bytes long, start long, end long, chrom string, pos long"}
BATCH_SITES, RANGE_BYTES = 256, 32 << 20
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def bare(chrom: str) -> str:
    return chrom[3:] if chrom[:3].lower() == "chr" else chrom


@dataclass(frozen=True)
class RangePartition(InputPartition):
    """Lines of a file between two bytes, where ``path`` is one."""

    path: str
    start: int
    end: int
    bytes: int = 0


@dataclass
class Region:
    """Wanted sites: chromosomes (any, where None) and the least and largest position. ``exact`` ones are names as they are in the file."""

    chroms: set[str] | None = None
    exact: set[str] | None = None
    low: int = 0
    high: int = 1 << 62

    def holds(self, chrom: str, pos: int) -> bool:
        return self.low <= pos <= self.high and (self.chroms is None or bare(chrom) in self.chroms) and (self.exact is None or chrom in self.exact)

    def meets(self, chrom: str, low: int, high: int) -> bool:
        return low <= self.high and high >= self.low and (self.chroms is None or bare(chrom) in self.chroms) and (self.exact is None or chrom in self.exact)

    def narrow(self, f: Filter) -> bool:
        """Take a filter over, where it is one of chromosome or position."""
        name, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
        if name == ("chrom",) and isinstance(f, (EqualTo, In)):
            wanted = {value} if isinstance(f, EqualTo) else set(value)
            self.exact = wanted if self.exact is None else self.exact & wanted
        elif name == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, value + isinstance(f, GreaterThan))
            self.high = min(self.high, value) if isinstance(f, EqualTo) else self.high
        elif name == ("pos",) and isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, value - isinstance(f, LessThan))
        else:
            return False
        return True


class VcfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.content, self.index = options["path"], options.get("content", "sites"), options.get("index")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        chroms = options.get("chroms")
        self.region = Region(chroms={bare(c) for c in chroms.split(",")} if chroms is not None else None, low=int(options.get("first", 0)), high=int(options.get("last", 1 << 62)))

    def files(self) -> list[tuple[str, int]]:
        store, place = bgzf.locate(self.path)
        info = store.get_file_info(place)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        head = self.path[: len(self.path) - len(place)] if "://" in self.path else ""
        found = store.get_file_info(fs.FileSelector(place, recursive=True))
        hidden = [x for x in found if any(part[:1] in ("_", ".") for part in x.path[len(place) :].split("/"))]
        return [(head + x.path, x.size) for x in sorted(found, key=lambda x: (-x.size, x.path)) if x.path.endswith((".vcf", ".vcf.gz", ".vcf.bgz")) and x not in hidden]

    def partitions(self) -> list[RangePartition]:
        """Ranges of all files; with an index, those that may hold a wanted site."""
        if self.index:
            return self._indexed()
        out = []
        for path, size in self.files():
            step = self.range_bytes if self.content != "samples" and (not path.endswith((".gz", ".bgz")) or bgzf.is_blocked(path)) else max(1, size)
            out += [RangePartition(path, at, min(at + step, size), size) for at in range(0, size, step)]
        return out or [RangePartition("", 0, 0)]

    def _indexed(self) -> list[RangePartition]:
        store, place = bgzf.locate(self.index)
        rows = pq.read_table(place, filesystem=store).to_pylist()
        sizes, known = dict(self.files()), {(r["path"], r["bytes"]) for r in rows}
        if stale := [p for p, n in sizes.items() if n and (p, n) not in known]:
            raise ValueError(f"the index does not fit {sorted(stale)[0]} and {len(stale) - 1} more: make it anew")
        wanted = sorted({(r["path"], r["start"], r["end"]) for r in rows if r["path"] in sizes and r["chrom"] is not None and self.region.meets(r["chrom"], r["low"], r["high"])})
        out: list[RangePartition] = []
        for path, start, end in wanted:
            if out and (out[-1].path, out[-1].end) == (path, start) and end - out[-1].start <= self.range_bytes:
                out[-1] = RangePartition(path, out[-1].start, end, sizes[path])
            else:
                out.append(RangePartition(path, start, end, sizes[path]))
        return out or [RangePartition("", 0, 0)]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if self.content == "samples":
            yield self._batch([(partition.path, i, s) for i, s in enumerate(header(partition.path))])
            return
        samples = header(partition.path) if self.content == "sites" else []
        rows: list[tuple] = []
        for line in _lines(partition):
            if line[:1] == "#" or line.count("\t") < 4:
                continue
            chrom, place, _ = line.split("\t", 2)
            if not self.region.holds(chrom, int(place)):
                continue
            rows.append(_site(partition.path, line, samples) if self.content == "sites" else (partition.path, partition.bytes, partition.start, partition.end, chrom, int(place)))
            if len(rows) == BATCH_SITES:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names, kinds = zip(*(c.split() for c in CONTENTS[self.content].split(", ")), strict=True)
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


class FilteringVcfReader(VcfReader):
    """Takes filters of chromosome and position over from Spark."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        for f in filters:
            if not self.region.narrow(f):
                yield f


def _lines(partition: RangePartition) -> Iterator[str]:
    if partition.path.endswith((".gz", ".bgz")) and not bgzf.is_blocked(partition.path):
        store, place = bgzf.locate(partition.path)
        with io.TextIOWrapper(gzip.GzipFile(fileobj=store.open_input_stream(place, compression=None)), encoding="utf-8") as text:
            for line in text:
                yield line.rstrip("\r\n")
        return
    yield from bgzf.lines(partition.path, partition.start, partition.end)


def header(path: str) -> list[str]:
    """Sample ids of a file, from its first lines alone."""
    for line in _lines(RangePartition(path, 0, 1 << 62)):
        if line[:1] != "#":
            break
        if line[:2] != "##":
            return line.split("\t")[9:]
    return []


def _site(path: str, line: str, samples: list[str]) -> tuple:
    cells = line.split("\t")
    at = cells[8].split(":").index("GT") if len(cells) > 8 and "GT" in cells[8].split(":") else None
    calls = [c.split(":")[at] for c in cells[9:]] if at is not None else ["./."] * len(samples)
    return path, cells[0], int(cells[1]), cells[3], cells[4].split(","), samples, calls


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class VcfWriter(DataSourceArrowWriter):
    """One block-compressed file for each task with rows, in the order of its rows; files appear when all tasks are done."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.token = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, place = bgzf.locate(self.path)
        name = f"{place}/_temporary-{self.token}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.vcf.gz"
        out, buffer, samples = None, bytearray(), None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    samples = row["sample_ids"]
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name, compression=None)
                    buffer += ("##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]) + "\n").encode()
                if row["sample_ids"] != samples:
                    raise ValueError("sites of one file have different samples")
                buffer += ("\t".join([row["chrom"], str(row["pos"]), ".", row["ref"], ",".join(row["alts"]), ".", ".", ".", "GT", *row["genotypes"]]) + "\n").encode()
                while len(buffer) >= bgzf.MOST_RAW:
                    out.write(bgzf.pack(bytes(buffer[: bgzf.MOST_RAW])))
                    del buffer[: bgzf.MOST_RAW]
        if out is None:
            return Written(None)
        if buffer:
            out.write(bgzf.pack(bytes(buffer)))
        out.write(bgzf.END)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, place = bgzf.locate(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        store.create_dir(place, recursive=True)
        for m in messages:
            if m and m.path:
                store.move(m.path, f"{place}/{m.path.rpartition('/')[2]}")
        self._clean(store, place)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*bgzf.locate(self.path))

    def _clean(self, store: fs.FileSystem, place: str) -> None:
        temporary = f"{place}/_temporary-{self.token}"
        if store.get_file_info(temporary).type == fs.FileType.Directory:
            store.delete_dir(temporary)


class VcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return CONTENTS[self.options.get("content", "sites")]

    def reader(self, schema) -> VcfReader:
        return (FilteringVcfReader if self.options.get("filters") == "true" else VcfReader)(self.options)

    def writer(self, schema, overwrite: bool) -> VcfWriter:
        return VcfWriter(self.options, overwrite)


def _pushes(spark: SparkSession) -> bool:
    return str(spark.conf.get(PUSHDOWN, "false")).lower() == "true"


def _load(spark: SparkSession, path: str, content: str, **options) -> DataFrame:
    spark.dataSource.register(VcfSource)
    filters = "true" if _pushes(spark) else "false"
    chosen = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format("vcf").options(content=content, filters=filters, **chosen).load(path)


def read_sites(
    spark: SparkSession, path: str, chroms: list[str] | None = None, first: int | None = None, last: int | None = None, index: str | None = None, range_bytes: int | None = None
) -> DataFrame:
    """Sites of all files below ``path``; of wanted chromosomes and positions alone where given.

    Where the session has ``spark.sql.python.filterPushdown.enabled``, filters of the result on ``chrom`` and ``pos`` reach the source too. The result has a filter of
    its own then: Spark keeps the ranges of the last plan that pushed filters for later plans of the same relation that push none. With an
    ``index`` (see ``write_index``) ranges without a wanted site are not read. An index of other files, or of files that have changed, is an error.
    """
    sites = _load(spark, path, "sites", chroms=",".join(chroms) if chroms is not None else None, first=first, last=last, index=index, rangebytes=range_bytes)
    return sites.where(F.col("pos") >= 0) if _pushes(spark) else sites


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """``path, place, sample_id`` of every file, from headers alone."""
    return _load(spark, path, "samples")


def write_index(spark: SparkSession, path: str, index: str, range_bytes: int = 1 << 20) -> DataFrame:
    """For every range of about ``range_bytes`` compressed bytes of every file, each chromosome's least and largest position and number of sites, as Parquet at ``index``."""
    ranges = _load(spark, path, "ranges", rangebytes=range_bytes)
    found = ranges.groupBy("path", "bytes", "start", "end", "chrom").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count(F.lit(1)).alias("sites"))
    found.write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)


def write_sites(sites: DataFrame, path: str, mode: str = "append") -> None:
    """Sites as block-compressed files, one for each partition with rows, in the order of its rows."""
    sites.sparkSession.dataSource.register(VcfSource)
    sites.select("chrom", "pos", "ref", "alts", "sample_ids", "genotypes").write.format("vcf").mode(mode).save(path)


def to_dosages(sites: DataFrame, per_alternative: bool = False) -> DataFrame:
    """Long genotypes. The dosage is the sum of allele numbers under the first alternative's label; ``per_alternative``
    gives each alternative its own label and counts only its alleles. A call with a missing allele is null.
    """
    cells = F.explode(F.arrays_zip("sample_ids", "genotypes"))
    rows = sites.withColumn("_c", cells)
    alleles = F.transform(F.split("_c.genotypes", r"[/|]"), lambda a: a.try_cast("int"))
    if per_alternative:
        rows = rows.select("*", F.posexplode("alts").alias("_at", "alt"))
        value = F.aggregate(alleles, F.lit(0), lambda t, a: t + F.when(a == F.col("_at") + 1, 1).when(a.isNotNull(), 0))
    else:
        rows = rows.withColumn("alt", F.get("alts", F.lit(0)))
        value = F.aggregate(alleles, F.lit(0), lambda t, a: t + a)
    return rows.select("path", F.regexp_replace("chrom", "(?i)^chr", "").alias("chrom"), "pos", "ref", "alt", F.concat_ws("_", F.regexp_replace("chrom", "(?i)^chr", ""), F.col("pos").cast("string"), "ref", "alt").alias("variant"), F.col("_c.sample_ids").alias("sample_id"), value.alias("dosage"))


def lookup(dosages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of wanted ``chrom, pos, ref, alt`` from per-alternative dosages, and wanted sites without a match, with whether the position exists."""
    key = ["chrom", "pos", "ref", "alt"]
    found = dosages.join(wanted, key, "left_semi")
    places = dosages.select("chrom", "pos").distinct().withColumn("position_exists", F.lit(True))
    absent = wanted.join(dosages, key, "left_anti").join(places, ["chrom", "pos"], "left").withColumn("position_exists", F.coalesce("position_exists", F.lit(False)))
    return found, absent


def repeated_chromosomes(sites: DataFrame) -> DataFrame:
    """Chromosomes that more than one file holds."""
    return sites.groupBy(F.regexp_replace("chrom", "(?i)^chr", "").alias("chrom")).agg(F.array_sort(F.collect_set("path")).alias("files")).where(F.size("files") > 1)


def probe_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".vcf.gz", ".vcf.bgz", ".parquet")) -> DataFrame:
    """``path, bytes, blocks, valid, reason`` of every file below ``path`` with one of ``suffixes``: compressed files are read whole and checked block by block, of Parquet files the footer is read.

    Each file is a row dealt to a task of its own; a file that fails is a row with a reason, for a retry list. An empty folder gives no row.
    """
    store, place = bgzf.locate(path)
    head = path[: len(path) - len(place)] if "://" in path else ""
    found = [store.get_file_info(place)] if store.get_file_info(place).type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
    names = sorted((x.size, head + x.path) for x in found if x.type == fs.FileType.File and x.path.endswith(suffixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *_probed(p)) for p in batch.column(0).to_pylist()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["path", "bytes", "blocks", "valid", "reason"])

    listed = spark.createDataFrame([(p,) for _, p in names], "path string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)), "path")
    return listed.mapInArrow(run, "path string, bytes long, blocks long, valid boolean, reason string")


def _probed(path: str) -> tuple[int | None, int | None, bool, str | None]:
    try:
        if path.endswith(".parquet"):
            store, place = bgzf.locate(path)
            footer = pq.read_metadata(place, filesystem=store)
            return store.get_file_info(place).size, footer.num_row_groups, True, None
        return *bgzf.probe(path), True, None
    except (OSError, ValueError, pa.ArrowException) as error:
        return None, None, False, str(error)
