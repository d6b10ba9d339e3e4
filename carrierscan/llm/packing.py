"""Best-fit packing planned on a length histogram."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.llm.common import binary_array, materialize, release, salt, spread, text_slices, whole_row

CAPACITY = 1024
#: Characters of one run of white space from which the tokenizer itself takes a text: the faster encoder overflows its stack on runs of about a million.
LONG_BLANK = 100_000
EOS = 2
#: Rows of equal length that look for their slot among the same entries of the plan.
RANK_BLOCK = 1024
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _encoders(path: str, ranks: str | None, pattern: str):
    """A tokenizer, its special strings, and a faster encoder of the same vocabulary where a rank file is given."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, fast = Tokenizer.from_file(path), None
    if ranks:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()], fast


def text_ids(path: str, ranks: str | None = None, pattern: str = "") -> Callable[[list[str]], list[bytes]]:
    """Token ids (little-endian unsigned 32-bit) of whole texts, as the tokenizer file at ``path`` gives them.

    ``ranks`` may name the same vocabulary as merge ranks, with the ``pattern`` that splits texts: the ids are equal and come
    several times faster. Texts that hold a special token's string or a long run of white space, and those that the faster encoder
    fails on, go to the tokenizer itself.
    """
    tokenizer, special, fast = _encoders(path, ranks, pattern)

    def quick(text: str) -> list[int] | None:
        if fast is None or any(x in text for x in special):
            return None
        if len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in re.finditer(r"\s+", text)):
            return None
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # A panic of the encoder is no Exception.
            return None

    def encode(texts: list[str]) -> list[bytes]:
        found = [quick(t) for t in texts]
        rest = iter(tokenizer.encode_batch_fast([t for t, ids in zip(texts, found, strict=True) if ids is None], add_special_tokens=False))
        return [np.array(next(rest).ids if ids is None else ids, "<u4").tobytes() for ids in found]

    return encode


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos: int = EOS, ranks: str | None = None, pattern: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids``.

    A document is its token ids and then ``eos``. One longer than ``capacity`` is cut into pieces of
    ``capacity`` tokens, of which the first may be shorter. Null and empty texts are ``eos`` alone; repeated rows
    give repeated pieces; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = text_ids(tokenizer_path, ranks, pattern), np.array([eos], "<u4").tobytes()
        for batch in text_slices(batches):
            out, docs_of, piece, start, length = [], [], [], [], []
            for row, ids in enumerate(encode(batch.column(1).to_pylist())):
                n = len(ids) // 4 + 1
                count = -(-n // capacity)
                first = n - (count - 1) * capacity
                ends = first + capacity * np.arange(count)
                begins = np.maximum(ends - capacity, 0)
                docs_of.append(np.full(count, row))
                piece.append(np.arange(count, dtype=np.int32))
                start.append(begins)
                length.append(ends - begins)
                out += [ids, end]
            lengths = np.concatenate(length).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate(docs_of))),
                    pa.array(np.concatenate(piece)),
                    pa.array(np.concatenate(start).astype(np.int64)),
                    pa.array(lengths),
                    binary_array(b"".join(out), np.concatenate([[0], np.cumsum(lengths * 4)])),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
        # Encoders are a task's own: an idle worker keeps none of their memory.
        del encode
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, rank_from, rank_to, sequence_from, offset)``.

    Pieces of ``length`` with rank in ``[rank_from, rank_to)`` go to sequence
    ``sequence_from + rank - rank_from`` at ``offset``. Alike sequences are one entry, so the work depends on the
    number of different lengths and fills, not on the number of pieces.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(first: int, count: int, room: int, times: int) -> None:
            nonlocal rank, left
            for k in range(times):
                plan.append((length, rank, rank + count, first, capacity - room + k * length))
                rank += count
            left -= count * times
            if room > times * length:
                free[room - times * length].append((first, count))

        for room in range(length, capacity + 1):
            while left and free[room]:
                first, count = free[room].pop()
                fits = room // length
                whole = min(count, left // fits)
                if whole:
                    put(first, whole, room, fits)
                rest = count - whole
                if rest and left:
                    put(first + whole, 1, room, left)
                    whole, rest = whole + 1, rest - 1
                if rest:
                    free[room].append((first + whole, rest))
            if not left:
                break
        if left:
            fits = capacity // length
            whole = left // fits
            if whole:
                put(sequences, whole, capacity, fits)
                sequences += whole
            if left:
                put(sequences, 1, capacity, left)
                sequences += 1
    return plan


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``; other columns stay.

    The histogram (at most ``capacity`` rows) goes to the driver, which plans; rows meet their slot by a join on the length, the block of
    the rank within it, and the rank. Ranks come from salted windows, so one length may hold all rows. Rows of equal length are
    interchangeable; an empty table gives an empty result. Columns named like the added ones, in upper or lower case, are replaced.
    """
    spark = pieces.sparkSession
    rows = materialize(pieces.select(whole_row(pieces, ("sequence_id", "offset")), "length", F.monotonically_increasing_id().alias("_uid")), "pieces")
    n = rows.count()
    rows = rows.withColumn("_salt", salt(F.col("_uid"), spread(spark, n)))
    counts = materialize(rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("every piece's length must be between 1 and the capacity")
    plan = spark.createDataFrame(plan_slots(histogram, capacity), "length long, _from long, _to long, _sequence long, _offset long")
    plan = materialize(plan.withColumn("_block", F.explode(F.expr(f"sequence(_from div {RANK_BLOCK}, (_to - 1) div {RANK_BLOCK})"))), "plan")
    base = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_base"))
    ranked = (
        rows.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_uid")))
        .join(base, ["length", "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_row") - 1)
        .withColumn("_block", F.expr(f"_rank div {RANK_BLOCK}"))
    )
    r, p = ranked.alias("r"), plan.alias("p")
    slot = (F.col("r.length") == F.col("p.length")) & (F.col("r._block") == F.col("p._block")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return r.join(p, slot).select("r._all.*", (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos: int = EOS, ranks: str | None = None, pattern: str = "") -> DataFrame:
    """Tokenize, cut and pack documents; ``ids`` holds each piece's tokens as little-endian unsigned 32-bit integers."""
    return place_pieces(tokenize_pieces(docs, tokenizer_path, capacity, eos, ranks, pattern), capacity)


def packed_digests(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos: int = EOS, ranks: str | None = None, pattern: str = "") -> DataFrame:
    """As ``pack_documents``, with ``ids_crc32`` instead of the ids: those are dropped before rows move."""
    pieces = tokenize_pieces(docs, tokenizer_path, capacity, eos, ranks, pattern)
    return place_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)

