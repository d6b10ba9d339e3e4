"""VCF files cut into ranges, indexed, filtered, written and probed, each against a whole read or a plain version."""

import gzip

import pytest
from pyspark.sql import functions as F

from carrierscan.sources import bgzf, vcf

SAMPLES = [f"S{i}" for i in range(5)]


def text(sites):
    head = "##fileformat=VCFv4.2\n##contig=<ID=chr1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(SAMPLES) + "\n"
    return head + "".join(f"{c}\t{p}\t.\tA\tG{',T' * (p % 2)}\t.\t.\t{'x' * (p % 700)}\tGT:DP\t" + "\t".join(f"{(p + i) % 2}|{(p * i) % 3}:9" for i in range(5)) + "\n" for c, p in sites)


SITES = [(c, 10 * p + k) for k, c in enumerate(("chr1", "chr2", "chr10")) for p in range(1, 400)]


def blocked(raw: bytes, most: int) -> bytes:
    return b"".join(bgzf.pack(raw[at : at + most]) for at in range(0, len(raw), most)) + bgzf.END


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("vcf")
    raw = text(SITES).encode()
    (where / "a.vcf.gz").write_bytes(blocked(raw, 3000))
    (where / "b.vcf").write_bytes(raw)
    (where / "c.vcf.gz").write_bytes(gzip.compress(raw))
    return where


@pytest.mark.parametrize("most", [100, 701, 3000, 65280])
@pytest.mark.parametrize("step", [50, 333, 4096, 1 << 20])
def test_ranges_give_each_line_once(tmp_path, most, step):
    raw = b"".join(b"%d %s\n" % (i, b"y" * (i * 37 % 900)) for i in range(120))
    for name, data in (("x.vcf.gz", blocked(raw, most)), ("x.vcf", raw), ("y.vcf", raw.rstrip(b"\n"))):
        path = str(tmp_path / name)
        (tmp_path / name).write_bytes(data)
        got = [line for at in range(0, len(data), step) for line in bgzf.lines(path, at, min(at + step, len(data)))]
        assert got == raw.decode().splitlines()


def rows(df):
    return sorted((r["chrom"], r["pos"], r["ref"], tuple(r["alts"]), tuple(r["sample_ids"]), tuple(r["genotypes"])) for r in df.collect())


def test_one_file_is_read_by_many_tasks(spark, folder):
    whole = rows(vcf.read_sites(spark, str(folder / "c.vcf.gz")))
    assert len(whole) == len(SITES)
    for name in ("a.vcf.gz", "b.vcf"):
        parts = vcf.read_sites(spark, str(folder / name), range_bytes=2000)
        assert parts.rdd.getNumPartitions() > 5 and rows(parts) == whole
    assert vcf.read_sites(spark, str(folder / "c.vcf.gz"), range_bytes=2000).rdd.getNumPartitions() == 1


def test_index_leaves_out_ranges(spark, folder, tmp_path):
    index = vcf.write_index(spark, str(folder / "a.vcf.gz"), str(tmp_path / "index"), 1500)
    assert index.agg(F.sum("sites")).head()[0] == len(SITES) and index.select("start").distinct().count() > 5
    whole = rows(vcf.read_sites(spark, str(folder / "a.vcf.gz")))
    options = {"index": str(tmp_path / "index"), "range_bytes": 4000}
    assert rows(vcf.read_sites(spark, str(folder / "a.vcf.gz"), **options)) == whole
    some = vcf.read_sites(spark, str(folder / "a.vcf.gz"), ["2"], 1001, 1500, **options)
    assert rows(some) == [r for r in whole if r[0] == "chr2" and 1001 <= r[1] <= 1500] and some.rdd.getNumPartitions() < 4
    assert rows(vcf.read_sites(spark, str(folder / "a.vcf.gz"), ["chr10"], **options)) == [r for r in whole if r[0] == "chr10"]
    assert vcf.read_sites(spark, str(folder / "a.vcf.gz"), ["7"], **options).count() == 0
    with pytest.raises(Exception, match="make it anew"):
        vcf.read_sites(spark, str(folder / "b.vcf"), **options).count()


def test_filters_reach_the_source(spark, folder, tmp_path):
    vcf.write_index(spark, str(folder / "a.vcf.gz"), str(tmp_path / "index"), 1500)
    whole = rows(vcf.read_sites(spark, str(folder / "a.vcf.gz")))
    spark.conf.set(vcf.PUSHDOWN, "true")
    try:
        sites = vcf.read_sites(spark, str(folder / "a.vcf.gz"), index=str(tmp_path / "index"), range_bytes=1500)
        near = sites.where((F.col("chrom") == "chr2") & (F.col("pos") > 500) & (F.col("pos") <= 700) & F.col("ref").startswith("A"))
        assert rows(near) == [r for r in whole if r[0] == "chr2" and 500 < r[1] <= 700]
        assert rows(sites) == whole and near.rdd.getNumPartitions() < sites.rdd.getNumPartitions() / 2
        assert rows(sites.where(F.col("chrom").isin("chr1", "2") & (F.col("pos") == 110))) == [r for r in whole if r[0] == "chr1" and r[1] == 110]
    finally:
        spark.conf.unset(vcf.PUSHDOWN)


def test_samples_from_the_header(spark, folder):
    got = vcf.sample_list(spark, str(folder))
    assert sorted((r["path"][-8:], r["place"], r["sample_id"]) for r in got.collect()) == sorted((n[-8:], i, s) for n in (f"{folder}/a.vcf.gz", f"{folder}/b.vcf", f"{folder}/c.vcf.gz") for i, s in enumerate(SAMPLES))


def test_written_sites_come_back(spark, folder, tmp_path):
    sites = vcf.read_sites(spark, str(folder / "a.vcf.gz"), range_bytes=3000)
    vcf.write_sites(sites.repartitionByRange(3, "chrom", "pos").sortWithinPartitions("chrom", "pos"), str(tmp_path / "out"))
    again = vcf.read_sites(spark, str(tmp_path / "out"), range_bytes=1000)
    assert rows(again) == rows(sites) and {p.name[-7:] for p in (tmp_path / "out").iterdir()} == {".vcf.gz"}
    assert [r["valid"] for r in vcf.probe_files(spark, str(tmp_path / "out")).collect()] == [True] * 3
    vcf.write_sites(sites.where("chrom = 'chr1'").coalesce(1), str(tmp_path / "out"), "overwrite")
    assert rows(vcf.read_sites(spark, str(tmp_path / "out"))) == [r for r in rows(sites) if r[0] == "chr1"]
    vcf.write_sites(sites.where("pos < 0"), str(tmp_path / "none"))
    assert vcf.read_sites(spark, str(tmp_path / "none")).count() == 0


def test_probes_tell_good_files_from_bad(spark, folder, tmp_path):
    good = (folder / "a.vcf.gz").read_bytes()
    wrong = bytearray(good)
    wrong[good.find(bgzf.MAGIC, len(good) // 2) + 60] ^= 255
    for name, data in {"good.vcf.gz": good, "cut.vcf.gz": good[:-200], "no_end.vcf.gz": good[: -len(bgzf.END)], "wrong.vcf.gz": bytes(wrong), "empty.vcf.gz": b"", "gzip.vcf.gz": gzip.compress(b"x" * 99), "half.vcf.gz": gzip.compress(b"x" * 9999)[:-9], "bad.parquet": b"PAR1....PAR1"}.items():
        (tmp_path / name).write_bytes(data)
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "table"))
    got = {r["path"].rpartition("/")[2]: r for r in vcf.probe_files(spark, str(tmp_path)).collect()}
    assert {n for n, r in got.items() if r["valid"]} == {"good.vcf.gz", "gzip.vcf.gz", *(n for n in got if n.startswith("part-"))}
    assert all(r["valid"] or r["reason"] for r in got.values()) and len(got) == 9
    assert got["good.vcf.gz"]["blocks"] > 10
