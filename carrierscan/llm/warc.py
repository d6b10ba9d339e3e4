"""WARC archives with one embedded Zstandard dictionary each and records compressed one by one."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierscan.llm.common import materialize, shared_dir

#: Fixed values of the file format: the magic number of the dictionary's skippable frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Parts to which the pages of one payload are dealt.
SALTS = 16
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def mark_revisits(pages: DataFrame, least: int = 100, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_digest, record_type, refers_to`` of each row; columns ``url`` and the id must be there, others are left out.

    Payload: the html in UTF-8 (null: empty). Of equal payloads of at least ``least`` bytes the smallest id is the response
    (all its rows, if it repeats) and others, those without an id too, revisit it. Groups without any id are all responses.
    Rows meet their group by digest and salt, shorter ones by a key of their own, so that no payload gathers in one task.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    own = F.xxhash64("page_id", "url")
    long_rows = rows.where(F.octet_length("payload") >= least)
    groups = long_rows.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first")).where("_n > 1 and _first is not null")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.octet_length("payload") >= least)
    met = F.when(F.octet_length("payload") >= least, F.col("payload_digest")).otherwise(own.cast("string"))
    firsts = groups.select(F.col("payload_digest").alias("_key"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return (
        rows.withColumns({"_key": met, "_salt": F.pmod(own, F.lit(SALTS)).cast("int")})
        .join(firsts, ["_key", "_salt"], "left")
        .withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_first"))})
        .drop("_first", "_key", "_salt")
    )


def _name(page_id: str | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _id(name: str) -> str | None:
    return name.removeprefix("<urn:x-page:").removesuffix(">") or None


def build_record(page_id: str | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: str | None, date: str) -> bytes:
    """One record in WARC/1.1. A revisit keeps the HTTP header, which tells the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_name(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """The row of ``RECORDS`` that a record holds; a payload that its digest or lengths deny raises."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or len(rest) != len(block) + 4:
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return _id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], None if revisit else payload, length, digest, _id(fields["WARC-Refers-To"]) if revisit else None


def train_dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from ``records``; none where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, records) if len(records) >= 8 else None
    except zstandard.ZstdError:
        return None


def write_archives(
    records: DataFrame, folder: str | None = None, level: int = 3, dictionary_bytes: int = 65_536, sample_bytes: int = 4 << 20, archive_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write rows of ``mark_revisits`` as ``*.warc.zst`` files in a shared folder; gives ``path, records, bytes``.

    Each task writes archives of its own rows. An archive's dictionary is trained on the archive's first ``sample_bytes`` of
    records (rows come dealt by digest, so those are no special ones), stored as the leading skippable frame, and every record is
    a frame of its own. An archive is closed beyond ``archive_bytes``. Files carry the task attempt in their name and only files
    of attempts that Spark accepted are in the manifest, which is written at once: a lost executor leaves at most orphans.
    """
    spark = records.sparkSession
    folder = folder or shared_dir(spark, "warc")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, made = TaskContext.get().taskAttemptId(), []

        def rows() -> Iterator[bytes]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    yield build_record(row.page_id, row.url, row.payload, row.payload_digest, row.record_type, row.refers_to, date)

        source = rows()
        while True:
            held, size = [], 0
            for record in source:
                held.append(record)
                size += len(record)
                if size >= sample_bytes:
                    break
            if not held:
                break
            words = train_dictionary(held, dictionary_bytes)
            press = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True)
            name = f"part-{task:010d}-{len(made):05d}.warc.zst"
            count = written = 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:

                def put(data: bytes) -> None:
                    nonlocal written
                    out.write(data)
                    written += len(data)

                body = words.as_bytes() if words else b""
                put(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
                for record in held:
                    put(press.compress(record))
                count = len(held)
                held = []
                while written < archive_bytes and (record := next(source, None)) is not None:
                    put(press.compress(record))
                    count += 1
            made.append((f"{folder}/{name}", count, written))
        yield pd.DataFrame(made, columns=["path", "records", "bytes"])

    text = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "payload_digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(text.mapInPandas(run, MANIFEST), "manifest")


def frames_of(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of one archive, in order, with one of them in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary's frame")
    body = stream.read(size)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    rest = stream.read(chunk)
    while rest:
        one, parts = press.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(parts)
        rest = rest or stream.read(chunk)


def read_archives(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives that ``manifest`` lists, as rows of ``RECORDS``; one task to an archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for frame in frames:
            for path in frame["path"]:
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    held, size = [], 0
                    for record in frames_of(stream):
                        held.append(parse_record(record))
                        size += len(record)
                        if size >= batch_bytes:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                    if held:
                        yield pd.DataFrame(held, columns=names)

    files = manifest.count()
    return manifest.select("path").repartition(max(1, files), "path").mapInPandas(run, RECORDS)


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write a record per page, read the archives back, and give the rows read."""
    return read_archives(write_archives(mark_revisits(pages, least)))
