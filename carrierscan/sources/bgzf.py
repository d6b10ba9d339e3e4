"""Block-compressed text files: blocks of gzip members that can be read from the middle, cut into ranges, and probed one by one."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs

#: Fixed values of the format: a block's first bytes, the empty block that ends a file, and the most that a block holds.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST_RAW = 65280
HEAD, CHUNK = 18, 1 << 20


class Corrupt(ValueError):
    """A block, member or footer that does not hold what it says."""


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def pack(raw: bytes) -> bytes:
    """One block of up to ``MOST_RAW`` bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    return MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def block_bytes(head: bytes) -> int | None:
    """A block's length by its first bytes; None where no block begins."""
    if len(head) < HEAD or head[:4] != MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    if extra != 6 or head[12:14] != b"BC" or struct.unpack_from("<H", head, 14)[0] != 2:
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def unpack(block: bytes) -> bytes:
    """A block's content, checked against its length and sum."""
    try:
        raw = zlib.decompressobj(-15).decompress(block[HEAD:-8])
    except zlib.error as error:
        raise Corrupt(f"a block does not decompress: {error}") from error
    crc, size = struct.unpack("<II", block[-8:])
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise Corrupt("a block's content differs from its sum")
    return raw


def is_blocked(path: str) -> bool:
    store, place = locate(path)
    with store.open_input_file(place) as f:
        return block_bytes(f.read(HEAD)) is not None


def first_block(f, size: int, at: int) -> int:
    """The first place from ``at`` on where a block begins: its bytes look like a block, and so do those that follow it."""
    if at == 0:
        return 0
    while at < size:
        f.seek(at)
        window = f.read(CHUNK)
        found = window.find(MAGIC)
        while found >= 0:
            place, steps = at + found, 0
            while steps < 3 and place < size:
                f.seek(place)
                step = block_bytes(f.read(HEAD))
                if step is None:
                    break
                place, steps = place + step, steps + 1
            if steps == 3 or place == size:
                return at + found
            found = window.find(MAGIC, found + 1)
        at += max(1, len(window) - 3) if len(window) == CHUNK else len(window)
        if not window:
            break
    return size


def chunks(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(place, content)`` of the blocks from the first that begins at ``start`` or later to the file's end; of a plain file, pieces that break at ``end``. The reader stops by itself."""
    store, place = locate(path)
    with store.open_input_file(place) as f:
        size = f.size()
        f.seek(0)
        if block_bytes(f.read(HEAD)) is None:
            at = start
            while at < size:
                f.seek(at)
                piece = f.read(min(CHUNK, end - at) if at < end else CHUNK)
                yield at, piece
                at += len(piece)
            return
        at = first_block(f, size, start)
        while at < size:
            f.seek(at)
            head = f.read(HEAD)
            step = block_bytes(head)
            if step is None:
                raise Corrupt(f"no block at byte {at} of {path}")
            block = head + f.read(step - HEAD)
            if len(block) < step:
                raise Corrupt(f"the block at byte {at} of {path} is cut off")
            yield at, unpack(block)
            at += step


def lines(path: str, start: int, end: int) -> Iterator[str]:
    """The lines of one range of a file. A line belongs to the range that holds its first byte, or the line end before it at a range's edge; so ranges that meet give each line once."""
    skip, rest = start > 0, b""
    for at, piece in chunks(path, start, end):
        if at >= end:
            # All blocks of the range are read: what is begun is finished, and no more.
            if skip:
                return
            cut = piece.find(b"\n")
            rest += piece if cut < 0 else piece[:cut]
            if cut >= 0:
                break
            continue
        if skip:
            cut = piece.find(b"\n")
            if cut < 0:
                continue
            piece, skip = piece[cut + 1 :], False
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line.decode().rstrip("\r")
    if rest and not skip:
        yield rest.decode().rstrip("\r")


def probe(path: str) -> tuple[int, int]:
    """Bytes and blocks of a file all of whose blocks are whole; raises ``Corrupt`` where one is not, or the empty last block is missing. A gzip file without blocks counts as one."""
    import gzip

    store, place = locate(path)
    with store.open_input_file(place) as f:
        size = f.size()
        if not size:
            raise Corrupt("the file is empty")
        blocked = block_bytes(f.read(HEAD)) is not None
        if blocked:
            f.seek(max(0, size - len(END)))
            if f.read(len(END)) != END:
                raise Corrupt("the last block is missing")
    if blocked:
        return size, sum(1 for _ in chunks(path, 0, size))
    try:
        with store.open_input_stream(place, compression=None) as stream, gzip.GzipFile(fileobj=stream) as f:
            while f.read(CHUNK):
                pass
    except (OSError, EOFError, zlib.error) as error:
        raise Corrupt(str(error)) from error
    return size, 1
