"""Media columns of timed GIF frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierscan.llm.common import text_slices

UNIT = 576
FRAME_ROWS = 512
#: Fixed values of the format: the largest code table, and the passes of an interlaced image as (first row, step).
MOST_CODES = 4096
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
HISTOGRAM_BINS = 8

FRAME_FIELDS = [
    pa.field("index", pa.int32()), pa.field("at_ms", pa.int64()), pa.field("delay_ms", pa.int32()), pa.field("left", pa.int32()), pa.field("top", pa.int32()),
    pa.field("width", pa.int32()), pa.field("height", pa.int32()), pa.field("disposal", pa.int32()), pa.field("transparent", pa.int32()),
    pa.field("samples", pa.binary()), pa.field("pixels", pa.binary()), pa.field("histogram", pa.list_(pa.int32())),
]
FRAMES = "frames array<struct<index int, at_ms long, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, samples binary, pixels binary, histogram array<int>>>"


class GifError(ValueError):
    """Bytes that are not a whole GIF."""


@lru_cache(maxsize=16)
def _code_bits(size: int) -> np.ndarray:
    """Width of the i-th code after a clear code."""
    first = (1 << size) + 1
    return np.array([min(12, (first + i).bit_length()) for i in range(MOST_CODES)], np.int64)


def lzw_codes(samples: bytes, size: int = 8) -> tuple[list[int], list[int]]:
    """Codes of ``samples`` between the first clear code and the end code, and how many codes each code table lasts.

    The table is a trie of dictionaries; None leads to a node's own code.
    """
    clear = 1 << size
    codes: list[int] = []
    runs, begun, emit = [], 0, codes.append
    roots = [{None: i} for i in range(clear)]
    free, node = clear + 2, roots[samples[0]]
    for byte in samples[1:]:
        child = node.get(byte)
        if child is not None:
            node = child
            continue
        emit(node[None])
        node[byte] = {None: free}
        node = roots[byte]
        free += 1
        if free == MOST_CODES:
            emit(clear)
            runs.append(len(codes) - begun)
            begun, roots, free = len(codes), [{None: i} for i in range(clear)], clear + 2
            node = roots[byte]
    emit(node[None])
    emit(clear + 1)
    runs.append(len(codes) - begun)
    return codes, runs


def lzw_pack(samples: bytes, size: int = 8) -> bytes:
    """The code stream of ``samples``, least significant bit first."""
    codes, runs = lzw_codes(samples, size) if samples else ([(1 << size) + 1], [1])
    widths = np.concatenate([[size + 1], *(_code_bits(size)[:n] for n in runs)])
    values = np.array([1 << size, *codes], np.uint16)
    bits = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _chase(parent: np.ndarray, depth: np.ndarray | None = None) -> np.ndarray:
    """Follow parents to their ends (own parents), all at once, in doubling steps; adds up ``depth`` on the way."""
    while True:
        up = parent[parent]
        if depth is not None:
            depth += depth[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes of one code table.

    The table's j-th own entry is what code j gave and the first sample after it, so it lies in the output itself: lengths follow from
    chains of entries, and each sample from a chain of earlier places.
    """
    n = len(codes)
    made = np.arange(n)
    # a full table takes no more entries, but codes past it are never read, so the bound below covers that case too
    entry = codes.astype(np.int64) - clear - 2
    own = entry >= 0
    if (entry >= made)[own].any() or (codes[0] >= clear) or ((codes >= clear) & ~own).any():
        raise GifError("a code points past its table")
    parent = np.where(own, entry, made)
    length = own.astype(np.int64)
    _chase(parent, length)
    length += 1
    end = np.cumsum(length)
    begin = end - length
    place = np.arange(end[-1])
    code = np.repeat(made, length)
    inside = place - begin[code]
    source = np.where(own[code], begin[parent[code]] + inside, place)
    return codes[code[_chase(source)]].astype(np.uint8)


def lzw_unpack(stream: bytes, size: int, most: int) -> bytes:
    """The first ``most`` samples of a code stream: codes are read many at once, up to the next clear or end code."""
    clear, known = 1 << size, _code_bits(size)
    bits = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    total, at, out, made = len(stream) * 8, 0, [], 0
    held: list[np.ndarray] = []
    ended = False
    while not ended and made < most:
        since = sum(map(len, held))
        width = known[since:] if since < len(known) else np.full(MOST_CODES, 12, np.int64)
        ends = at + np.cumsum(width)
        ends = ends[: int(np.searchsorted(ends, total, "right"))]
        width = width[: len(ends)]
        begins = ends - width
        byte = begins >> 3
        codes = ((bits[byte] | bits[byte + 1] << np.uint32(8) | bits[byte + 2] << np.uint32(16)) >> (begins & 7).astype(np.uint32)) & ((np.uint32(1) << width.astype(np.uint32)) - np.uint32(1))
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        held.append(codes[:n])
        ended = not len(codes) or bool(len(stops)) and codes[n] == clear + 1
        at = int(ends[n]) if len(stops) else int(ends[-1]) if len(ends) else at
        if len(stops) or ended:
            table = np.concatenate(held)
            held = []
            if len(table):
                out.append(_expand(table, clear))
                made += len(out[-1])
    return b"".join(part.tobytes() for part in out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_gif(payload: bytes, width: int = UNIT, frame_rows: int = FRAME_ROWS, delay_cs: int = 10) -> bytes:
    """An animation whose palette indices, frame by frame and row by row, are ``payload`` (whole rows of ``width``)."""
    rows = len(payload) // width
    if not rows or len(payload) % width:
        raise GifError("a payload is a positive number of whole rows")
    height = min(rows, frame_rows)
    grey = bytes(v for i in range(256) for v in (i, i, i))
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), grey, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for top in range(0, rows, frame_rows):
        samples = payload[top * width : (top + frame_rows) * width]
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(samples) // width, 0), b"\x08", _blocks(lzw_pack(samples))]
    return b"".join([*parts, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("the file ends within a block")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    table = np.zeros((256, 3), np.uint8)
    table[: n // 3] = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
    return table, at + n


def decode_gif(data: bytes, pixels: bool = False) -> Iterator[dict]:
    """Frames of a GIF: timing, place, disposal, palette indices in row order, and the shown canvas's colour histogram.

    ``pixels`` adds the canvas as RGBA. Disposal 2 clears the frame's rectangle to transparent before the next frame, 3 brings back
    what was there before it; transparent samples leave the canvas as it is. The histogram counts opaque canvas
    pixels in eight bins each of red, green and blue. Frames that reach past the screen are cut for the canvas only.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("not a GIF")
    screen_w, screen_h, flags = struct.unpack("<HHB", data[6:11])
    shared, at = _palette(data, 13, flags)
    drawn: np.ndarray | None = None
    whole: tuple[np.ndarray, np.ndarray] | None = None

    def canvas() -> np.ndarray:
        """The canvas as RGBA; a frame that covers all of it is drawn only when something needs it."""
        nonlocal drawn, whole
        if drawn is None:
            drawn = np.zeros((screen_h, screen_w, 4), np.uint8)
        if whole:
            drawn[..., :3], drawn[..., 3], whole = whole[1][whole[0]], 255, None
        return drawn

    delay, disposal, transparent, index, clock = 0, 0, -1, 0, 0
    while True:
        if at >= len(data):
            raise GifError("the file ends without its trailer")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index_t = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index_t if packed & 1 else -1
            continue
        if kind != 0x2C:
            raise GifError("an unknown block")
        left, top, width, height, packed = struct.unpack("<HHHHB", data[at : at + 9])
        own, at = _palette(data, at + 9, packed)
        size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        raw = lzw_unpack(stream, size, width * height)
        if len(raw) < width * height:
            raise GifError("an image has too few samples")
        image = np.frombuffer(raw, np.uint8).reshape(height, width)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, height, step) for a, step in PASSES])
            image = image[np.argsort(order)]
        table = own if own is not None else shared if shared is not None else np.zeros((256, 3), np.uint8)
        cut = (slice(top, top + height), slice(left, left + width))
        part = image[: max(0, screen_h - top), : max(0, screen_w - left)]
        before = canvas()[cut].copy() if disposal == 3 else None
        if transparent < 0 and part.shape == (screen_h, screen_w):
            whole = (part, table)
            times = np.bincount(part.reshape(-1), minlength=256)
            histogram = np.concatenate([np.bincount(table[:, k] >> 5, times, HISTOGRAM_BINS) for k in range(3)])
        else:
            shown = canvas()
            seen = part != transparent
            shown[cut][seen] = np.concatenate([table, np.full((256, 1), 255, np.uint8)], axis=1)[part[seen]]
            bins = shown[shown[..., 3] > 0] >> 5
            histogram = np.concatenate([np.bincount(bins[:, k], minlength=HISTOGRAM_BINS) for k in range(3)])
        yield {
            "index": index, "at_ms": clock, "delay_ms": delay * 10, "left": left, "top": top, "width": width, "height": height, "disposal": disposal, "transparent": transparent,
            "samples": image.tobytes(), "pixels": canvas().tobytes() if pixels else None, "histogram": histogram.astype(int).tolist(),
        }
        index, clock = index + 1, clock + delay * 10
        if disposal == 2:
            canvas()[cut] = 0
        elif disposal == 3:
            canvas()[cut] = before
        delay, disposal, transparent = 0, 0, -1


def text_media(docs: DataFrame, unit: int = UNIT, frame_rows: int = FRAME_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes (null: none), padded with 255 to a positive multiple of ``unit``, as a GIF.

    Equal texts have equal media. Repeated rows stay; a null id stays null; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            media = [encode_gif(t + b"\xff" * (unit - len(t) % unit if len(t) % unit or not t else 0), unit, frame_rows) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_frames(rows: DataFrame, media_col: str = "media", pixels: bool = False, joined: bool = False) -> DataFrame:
    """All columns of ``rows`` with ``frames``: the media's timed frames, null where the media are null or no whole GIF.

    With ``joined``, the samples of all frames are one column ``samples`` instead of being in the frames. Columns named like the added ones are replaced.
    """
    kept = rows.drop("frames", "samples") if joined else rows.drop("frames")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), FRAMES, *["samples binary"] * joined])
    kind = pa.list_(pa.struct(FRAME_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, media_col, 2 << 20):
            frames: list[list[dict] | None] = []
            for data in batch.column(batch.schema.get_field_index(media_col)).to_pylist():
                try:
                    frames.append(None if data is None else list(decode_gif(data, pixels)))
                except (GifError, IndexError, struct.error):
                    frames.append(None)
            whole = []
            if joined:
                whole = [pa.array([None if f is None else b"".join([x.pop("samples") for x in f]) for f in frames], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(frames, kind), *whole], names=[*batch.schema.names, "frames", *["samples"] * joined])

    return kept.mapInArrow(run, schema)
