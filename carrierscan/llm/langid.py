"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierscan.llm.common import materialize, mix64, text_slices, with_text_columns

SIZES = (3, 4)
#: Rows of each language that a model is fitted on at most, chosen by the hash of their ids.
SAMPLE_ROWS = 4000
LEAST_COUNT = 3
#: A language has an n-gram when its rate there is this share of the highest rate of any language.
RATE_SHARE = 0.25
PROBES = 3
BITS_PER_GRAM = 12
#: Bytes of all slices, which are broadcast, at most: beyond it an n-gram has fewer bits, so that more hits are by chance and are taken off.
MOST_BYTES = 128 << 20
#: Languages of one mask; more languages take more masks for each bit.
MASK_BITS = 64
#: Characters whose n-grams are held at once.
PART = 1 << 18
#: N-grams that a task counts before it passes them on.
FLUSH = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageFilter:
    """``slices[w][i]`` has those languages of the ``w``-th 64 that set bit ``i``, as a mask; ``false_rate`` is each language's rate of chance hits."""

    languages: tuple[str, ...]
    slices: tuple[np.ndarray, ...]
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """The languages that contain each n-gram: all of its bit slices, and-ed; a mask for every 64 languages."""
        found: list[np.ndarray] = []
        for place in _places(grams, len(self.slices[0])) if self.slices else ():
            found = [s[place] & f for s, f in zip(self.slices, found, strict=True)] if found else [s[place] for s in self.slices]
        return found


def _places(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    low, step = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32) | np.uint64(1)
    for k in range(PROBES):
        yield ((low + step * np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of lower-cased texts and the text of each, about ``PART`` at a time, with a gap (0) around each piece.

    A longer text is cut where it has a character that is no letter. No n-gram has such a character inside, and one may
    begin or end with it, so that cutting there changes no n-gram; a longer run of letters alone stays in one piece.
    """
    letters, gap = _letters(), np.zeros(1, np.uint32)
    held, owners, total = [], [], 0
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        at = 0
        while at < len(codes):
            end, far = min(at + PART - total, len(codes)), at + PART
            if end < len(codes):
                cut = np.flatnonzero(~letters[codes[at:end]])
                while not len(cut) and far < len(codes):
                    end, far = min(far, len(codes)), far + PART
                    cut = np.flatnonzero(~letters[codes[at:end]])
                end = at + int(cut[-1]) + 1 if len(cut) else len(codes)
            held += [gap, codes[at:end], gap]
            owners.append((i, end - at + 2))
            total += end - at + 2
            at = end
            if total >= PART // 2:
                yield np.concatenate(held), np.repeat(*map(np.array, zip(*owners, strict=True)))
                held, owners, total = [], [], 0
    if held:
        yield np.concatenate(held), np.repeat(*map(np.array, zip(*owners, strict=True)))


def text_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of whole lower-cased texts, and the text of each, in parts of bounded size.

    Runs of characters that are no letters count as one blank; an n-gram may begin or end with a blank but has none inside.
    """
    letters = _letters()
    for codes, owner in _parts(texts):
        solid = letters[codes]
        keep = solid.copy()
        keep[0] = True
        keep[1:] |= solid[:-1] | (owner[1:] != owner[:-1])
        codes, owner, solid = np.where(solid, codes, np.uint32(0))[keep], owner[keep], solid[keep]
        for n in SIZES:
            last = len(codes) - n + 1
            if last < 1:
                continue
            good = owner[:last] == owner[n - 1 :]
            for k in range(1, n - 1):
                good &= solid[k : last + k]
            at = np.flatnonzero(good)
            value = np.full(len(at), n, np.uint64)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + codes[at + k]
            yield mix64(value), owner[at]


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """Learn from text and language alone, of at most about ``rows`` documents of each language.

    Documents are chosen by the hash of their ids, against a share that makes ``rows`` the expected number; whole texts are counted in the tasks. Rows without a language or text teach
    nothing; any number of languages is learned; with none, every prediction is ``und``. The driver gets one row for each language and the filter.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageFilter((), (), np.zeros(0))
    draw = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    named = docs.sparkSession.createDataFrame([(x, i, min(1.0, rows / sizes[x])) for i, x in enumerate(languages)], "lang string, number int, share double")
    chosen = known.join(F.broadcast(named), "lang").where(draw < F.col("share")).select("number", "text")

    def counted(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for i, grams in held.items():
            value, times = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.full(len(value), i, np.int32)), pa.array(times)], names=["gram", "lang", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        total = 0
        for batch in text_slices(batches):
            which = batch.column(0).to_numpy()
            for value, owner in text_grams(batch.column(1).to_pylist()):
                lang = which[owner]
                for i in np.unique(lang).tolist():
                    held.setdefault(i, []).append(value[lang == i])
                total += len(value)
                if total >= FLUSH:
                    yield from counted(held)
                    held, total = {}, 0
        yield from counted(held)

    counts = materialize(chosen.mapInArrow(count, "gram long, lang int, times long").groupBy("gram", "lang").agg(F.sum("times").alias("times")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("times").cast("double").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("times") / F.col("total"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    held = rated.withColumn("best", best).where((F.col("times") >= LEAST_COUNT) & (F.col("rate") >= RATE_SHARE * F.col("best")))
    word = F.expr(f"lang div {MASK_BITS}").cast("int").alias("word")
    grams = materialize(held.groupBy("gram", word).agg(F.bit_or(F.expr(f"shiftleft(1L, lang % {MASK_BITS})")).alias("mask")), "masks")
    most = MOST_BYTES // -(-len(languages) // 8) if len(languages) <= MASK_BITS else MOST_BYTES // (8 * -(-len(languages) // MASK_BITS))
    bits = 1 << max(10, int(grams.select("gram").distinct().count() * BITS_PER_GRAM - 1).bit_length())
    bits = max(1024, min(bits, 1 << (most.bit_length() - 1)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            for place in _places(gram, bits):
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(place), batch.column(2)], names=["word", "place", "mask"])

    slices = np.zeros((-(-len(languages) // MASK_BITS), bits), np.uint64)
    merged = grams.select("gram", "word", "mask").mapInArrow(places, "word int, place long, mask long").groupBy("word", "place").agg(F.bit_or("mask").alias("mask")).toArrow()
    slices[merged.column("word").to_numpy(), merged.column("place").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
    fill = np.array([((slices[i // MASK_BITS] >> np.uint64(i % MASK_BITS)) & np.uint64(1)).mean() for i in range(len(languages))])
    small = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
    return LanguageFilter(languages, tuple(slices.astype(small)), fill**PROBES)


def identify(texts: list[str | None], model: LanguageFilter) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts. Score: the share of the text's n-grams that its language has, chance hits taken off."""
    sizes = np.zeros(len(texts), np.int64)
    hits = np.zeros((len(model.languages), len(texts)), np.int64)
    for grams, owner in text_grams([t or "" for t in texts]):
        sizes += np.bincount(owner, minlength=len(texts))
        masks = model.masks(grams)
        for i in range(len(model.languages)):
            mask = masks[i // MASK_BITS]
            hits[i] += np.bincount(owner[(mask >> mask.dtype.type(i % MASK_BITS)) & mask.dtype.type(1) > 0], minlength=len(texts))
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    false = model.false_rate[:, None]
    shares = np.clip((hits / np.maximum(sizes, 1) - false) / (1 - false), 0, 1)
    best = shares.argmax(axis=0)
    names = [model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
    return names, np.where(sizes > 0, shares.max(axis=0), 0.0)


def predict_languages(docs: DataFrame, model: LanguageFilter, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default) with ``lang_pred, lang_score``, from whole texts.

    Null texts, empty texts and texts without a letter are ``und`` with score 0. Ties go to the language that comes first. Columns named like the added ones,
    in upper or lower case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> list[pa.Array]:
        names, scores = identify(texts, shared.value)
        return [pa.array(names, pa.string()), pa.array(scores)]

    return with_text_columns(docs, score, {"lang_pred": "string", "lang_score": "double"}, keep, text_col)
