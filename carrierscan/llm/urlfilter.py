"""URL rules behind a cascade of Bloom filters that is exact over the corpus's own keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.llm.common import LOWER, UPPER, materialize, mix64, whole_row

#: A filter larger than this is not broadcast; the keys are joined instead.
FILTER_BYTES = 64 << 20
FIRST_RATE, NEXT_RATE = 0.01, 0.5
MOST_LEVELS = 64


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``probes`` bits to a key."""

    words: np.ndarray
    probes: int
    level: int

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found = np.ones(len(one), bool)
        for place in _places(one, two, len(self.words) * 64, self.probes, self.level):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def _places(one: np.ndarray, two: np.ndarray, bits: int, probes: int, level: int):
    seed = np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    # The first place depends on both hashes too: later levels have one probe.
    b = mix64(two.view(np.uint64) + seed)
    a, b = mix64((one.view(np.uint64) ^ seed) + b), b | np.uint64(1)
    for k in range(probes):
        yield (a + b * np.uint64(k)) % np.uint64(bits)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as text: see ``judge_urls``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every key under which a rule could fit: host endings of up to ``labels`` labels by path beginnings of ``lengths`` characters, longest key first."""
    parts = F.split(host, r"\.", -1)
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(endings, lambda e: F.transform(starts, lambda s: F.struct((-F.length(F.concat(e, s))).alias("order"), F.concat(e, s).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(keys)["key"])


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key under different seeds: the second starts from the hash of a constant, so neither follows from the other."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def sized_bits(count: int, rate: float) -> int:
    return max(64, -(-math.ceil(count * -math.log(rate) / math.log(2) ** 2) // 64) * 64)


def set_bits(keys: DataFrame, bits: int, probes: int, level: int) -> Level:
    """A filter over ``keys`` (``_one, _two``): bits are set in the tasks, merged by 64-bit word, and only words travel."""
    bits = -(-bits // 64) * 64

    def words(batches):
        for batch in batches:
            one, two = (batch.column(i).to_numpy() for i in (0, 1))
            place = np.unique(np.concatenate(list(_places(one, two, bits, probes, level)))) if len(one) else np.zeros(0, np.uint64)
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"])

    got = keys.select("_one", "_two").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Level(table, probes, level)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(batch.column(0).to_numpy(), batch.column(1).to_numpy())))

    return keys.select("_one", "_two").mapInArrow(run, "_one long, _two long")


def build_cascade(universe: DataFrame, listed: DataFrame, rate: float = FIRST_RATE, next_rate: float = NEXT_RATE, most_bytes: int = FILTER_BYTES) -> list[Level] | None:
    """Levels over a complete key universe and the listed keys (``_one, _two`` key hashes of both; a listed key may be missing from the universe).

    Level 0 encodes the listed keys, level 1 the keys that level 0 lets through wrongly, level 2 the listed keys that level 1
    lets through, and so on until a level lets nothing through wrongly: then membership is exact for every key of the universe. Only keys
    that level 0 lets through are compared with the list. None when the listed keys
    need more than ``most_bytes``, so that the caller joins.
    """
    inside, outside = listed.select("_one", "_two").distinct(), universe
    levels: list[Level] = []
    count, p = inside.count(), rate
    while count:
        if count * -math.log(p) / math.log(2) ** 2 / 8 > most_bytes:
            return None
        if len(levels) >= MOST_LEVELS:
            raise ValueError("two keys of the universe agree in both hashes")
        levels.append(set_bits(inside, sized_bits(count, p), max(1, round(-math.log2(p))), len(levels)))
        passed = _passing(outside, levels[-1])
        inside, outside, p = materialize(passed if levels[1:] else passed.join(inside, ["_one", "_two"], "left_anti"), "cascade"), inside, next_rate
        count = inside.count()
    return levels


def is_member(levels: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether keys are listed: the parity of the first level that does not hold a key."""
    depth, alive = np.zeros(len(one), int), np.arange(len(one))
    for level in levels:
        alive = alive[level.holds(one[alive], two[alive])]
        depth[alive] += 1
    return depth % 2 == 1


ADDED = ("host", "path", "rule", "verdict")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url_col: str = "url", most_bytes: int = FILTER_BYTES) -> DataFrame:
    """All rows and columns of ``pages`` with ``host, path, rule, verdict``.

    ``rules`` are (verdict, host, path) with verdict ``allow`` or ``block``. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. A rule fits its host and all subdomains where the path begins with its own; the
    longest host and path wins, and the later rule of two that are the same. Without a rule the verdict is ``default``. Null
    urls and urls without ``://`` have empty parts and no rule; repeated rows stay. Columns named like the added ones, in upper or lower case, are replaced. Keys are the only thing that is made distinct; rows never move,
    unless the list is too large to broadcast.
    """
    spark = pages.sparkSession
    chosen = {host.lower() + path: (verdict, host.lower(), path) for verdict, host, path in rules}
    host, path = url_parts(F.col(url_col))
    rows = pages.select(whole_row(pages, ADDED), host.alias("host"), path.alias("path"))
    if not chosen:
        return rows.select("_all.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, lengths = max(h.count(".") + 1 for _, h, _ in chosen.values()), sorted({len(p) for _, _, p in chosen.values()})
    rows = rows.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    listed = _rules(spark, chosen)
    hashes = [h.alias(n) for h, n in zip(key_hashes(F.col("key")), ("_one", "_two"), strict=True)]
    universe = materialize(rows.select(F.explode("_keys").alias("key")).select(*hashes).distinct(), "universe")
    cascades = {v: build_cascade(universe, listed.where(F.col("_verdict") == v).select(*hashes), most_bytes=most_bytes) for v in ("allow", "block")}
    if any(c is None for c in cascades.values()):
        return _joined(rows, listed, default)
    shared = spark.sparkContext.broadcast(cascades)

    @F.arrow_udf("int")
    def first_rule(ones: pa.Array, twos: pa.Array) -> pa.Array:
        """Place (from 1) of the first key on a list, negative for the block list, else 0."""
        ends = ones.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        one, two = (np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.int64) for x in (ones, twos))
        sign = np.zeros(len(one), np.int32)
        for verdict, by in (("allow", 1), ("block", -1)):
            sign[is_member(shared.value[verdict], one, two)] = by
        hits, row = np.flatnonzero(sign), np.repeat(np.arange(len(ends)), ends)
        out = np.zeros(len(ends), np.int32)
        first, at = np.unique(row[hits], return_index=True)
        place = hits[at] - (np.cumsum(ends) - ends)[first] + 1
        out[first] = place * sign[hits[at]]
        return pa.array(out)

    hashes = [F.transform("_keys", lambda k: key_hashes(k)[0]), F.transform("_keys", lambda k: key_hashes(k)[1])]
    return (
        rows.withColumn("_hit", first_rule(*hashes))
        .withColumns({"rule": F.when(F.col("_hit") != 0, F.get("_keys", F.abs("_hit") - 1)), "verdict": F.when(F.col("_hit") > 0, "allow").when(F.col("_hit") < 0, "block").otherwise(default)})
        .select("_all.*", *ADDED)
    )


def _rules(spark: SparkSession, chosen: dict[str, tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, v[0]) for k, v in chosen.items()], "key string, _verdict string")


def _joined(rows: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The way for lists beyond the broadcast bound: keys meet rules in a shuffle join, and rows take their best hit back."""
    rows = materialize(rows.withColumn("_uid", F.monotonically_increasing_id()), "urls")
    hits = rows.select("_uid", F.posexplode("_keys").alias("_at", "key")).join(listed.hint("merge"), "key").groupBy("_uid").agg(F.min(F.struct("_at", "key", "_verdict")).alias("_hit"))
    return rows.join(hits, "_uid", "left").withColumns({"rule": F.col("_hit.key"), "verdict": F.coalesce("_hit._verdict", F.lit(default))}).select("_all.*", *ADDED)
