"""Exact Jaccard join on word shingles by rare-first prefix filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierscan.llm.common import binary_array, list_array, materialize, mix64, partitions, release, released, text_slices
from carrierscan.llm.urlfilter import Level, set_bits

#: Shingles that a task holds before it deals them out.
FLUSH = 1_000_000
#: Shingles that one bucket of the count gets on average at most.
BUCKET = 2_000_000
#: Bits of a token below its rarity level.
KEY_BITS = 56
#: Levels of rarity: four to each doubling of the document frequency.
LEVELS_PER_DOUBLING, MOST_LEVEL = 4, 127
#: Rounds that compare each token's classes with one of them, before what is left is compared pair by pair.
STAR_ROUNDS = 4
#: Pairs left for each prefix token, from which another star round pays.
PAIRS_LEFT = 2
#: Share of the pairs left that a star round must have settled for another one to pay.
SETTLED = 0.25
#: Depth of the suffix filter.
SUFFIX_DEPTH = 3
#: Text bytes that are hashed at once.
SLICE = 1 << 20
#: Tokens of sets that are worked on at once, but for a larger set.
TOKENS = 1 << 20
#: A class carries its size level in its low bits: steps of a sixteenth of a doubling.
SIZE_BITS, SIZES_PER_DOUBLING = 9, 16
#: The screening prefix has this share of a set beside the plain prefix, and as many of its shingles must be shared.
SCREEN = 0.2
#: Bytes of the filter of screened classes at most; a full filter lets more through and loses none.
SCREEN_BYTES = 8 << 20
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 4

_BASE = 0x9E3779B97F4A7C15


def _powers(size: int) -> np.ndarray:
    steps = np.full(max(1, size), _BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within a text, and how many each text has.

    Texts are lower-cased in A-Z and cut at blanks and control characters 9 to 13. A text with fewer words than a
    shingle has its whole word sequence as its one shingle. Hashes have 64 bits and stand for the shingles.
    """
    data, offsets = _bytes_of(column)
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begin = np.flatnonzero(solid & (fresh[:-1] | np.concatenate([[True], ~solid[:-1]])))
    end = np.flatnonzero(solid & (fresh[1:] | np.concatenate([~solid[1:], [True]]))) + 1
    length = end - begin
    first_byte = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(first_byte, length)
    part = (data[solid].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max(initial=1)))[inside]
    del inside, solid, fresh, data
    word = mix64((np.add.reduceat(part, first_byte) if len(part) else np.zeros(0, np.uint64)) + length.astype(np.uint64))
    del part
    text = np.searchsorted(offsets, begin, "right") - 1
    per_text = np.bincount(text, minlength=texts)
    first = np.cumsum(per_text) - per_text

    def fold(at: np.ndarray, n: int) -> np.ndarray:
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = mix64(value * np.uint64(_BASE) + word[at + k])
        return value

    at = np.arange(max(0, len(word) - words + 1))
    at = at[text[at] == text[at + words - 1]]
    values, owners = [fold(at, words)], [text[at]]
    for n in range(1, words):
        short = np.flatnonzero(per_text == n)
        values.append(fold(first[short], n))
        owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=texts)


def _signatures(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit signature of each set, whose low bits are the size's level; 0 for empty sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    end = np.cumsum(sizes)
    mixed = mix64(total[end] - total[end - sizes] + sizes.astype(np.uint64))
    level = np.floor(SIZES_PER_DOUBLING * np.log2(np.maximum(sizes, 1))).astype(np.uint64) + np.uint64(1)
    return np.where(sizes > 0, mixed >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS) | level, np.uint64(0)).view(np.int64)


def _documents(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, class`` of every row: equal sets are one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            value, sizes = shingle_sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(_signatures(value, sizes))], names=["doc_id", "n", "class"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, class long")


def _screen_share(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.floor(n * SCREEN).astype(np.int64))


def _deal(docs: DataFrame, words: int, bucket_bits: int, text_col: str, screen: tuple[int, int] | None = None, chosen: Level | None = None) -> DataFrame:
    """Each task's shingles, dealt to buckets by their last bits: one row for a task and bucket, copies within a task once.

    ``screen`` (the threshold) deals only each set's screening prefix in hash order; ``chosen`` deals only sets whose class it holds.
    """
    rest_bits = min(48, KEY_BITS - bucket_bits)
    shared = docs.sparkSession.sparkContext.broadcast(chosen) if chosen else None

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        value, sizes, classes = (np.concatenate(x) for x in zip(*held, strict=True))
        _, keep = np.unique(classes, return_index=True)
        kept = np.zeros(len(classes), bool)
        kept[keep] = True
        kept &= sizes > 0
        if shared:
            kept &= shared.value.holds(classes, mix64(classes.view(np.uint64)).view(np.int64))
        value = value[np.repeat(kept, sizes)]
        sizes, classes = sizes[kept], classes[kept]
        if screen:
            num, den = screen
            most = np.minimum(sizes, sizes - (sizes * num + den - 1) // den + _screen_share(sizes))
            value = value[np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(most, sizes)]
            sizes = most
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        bucket = (value & np.uint64((1 << bucket_bits) - 1)).astype(np.uint16 if bucket_bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, owner, value = bucket[order], owner[order], value[order] >> np.uint64(bucket_bits) & np.uint64((1 << rest_bits) - 1)
        if not len(value):
            return
        run = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])]))
        names, first = np.unique(bucket[run], return_index=True)
        runs = np.concatenate([first, [len(run)]])
        keys = np.concatenate([run[first], [len(value)]])
        lengths = np.diff(np.concatenate([run, [len(value)]])).astype("<u4")
        owner = owner[run]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names.astype(np.int32)),
                binary_array(classes[owner], runs * 8),
                binary_array(lengths, runs * 4),
                binary_array((value & np.uint64(0xFFFFFFFF)).astype("<u4"), keys * 4),
                binary_array((value >> np.uint64(32)).astype("<u2"), keys * 2),
            ],
            names=["bucket", "classes", "lengths", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in text_slices(batches, most=SLICE):
            value, sizes = shingle_sets(batch.column(0), words)
            held.append((value, sizes, _signatures(value, sizes)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "bucket int, classes binary, lengths binary, low binary, high binary")


def _screened(docs: DataFrame, words: int, classes: DataFrame, bucket_bits: int, text_col: str, num: int, den: int) -> Level:
    """A filter of the classes whose screening prefix shares enough shingles with prefixes of sets of fitting size.

    Two sets that link share, in any one order, as many shingles of their screening prefixes as the smaller set's share; so a
    class below the share of the smallest set it could link with is out.
    """
    dealt = _deal(docs, words, bucket_bits, text_col, (num, den))
    counts = _by_class(_live_tokens(dealt, bucket_bits, num, den, tokens=False), classes, bucket_bits, tokens=False)
    least = F.greatest(F.lit(1), F.floor(F.expr(f"n * {num} div {den}") * SCREEN))
    kept = materialize(counts.where(F.col("live") >= least).select(F.col("class").alias("_one")), "screened")
    n = kept.count()
    bits = min(SCREEN_BYTES * 8, max(64, n * 10))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mix64(one.view(np.uint64)).view(np.int64))], names=["_one", "_two"])

    return set_bits(kept.mapInArrow(hashed, "_one long, _two long"), bits, 4, 0)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The values in a table's column of binaries, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column(name))])


def _live_tokens(dealt: DataFrame, bucket_bits: int, num: int, den: int, tokens: bool = True) -> DataFrame:
    """``group, classes, lengths, tokens``: in each bucket, the shingles that a class shares with another class whose size level may fit.

    A token is the shingle's rarity level (of its document frequency over classes) and then its key, so that
    numeric order is rare-first. A shingle shared with classes of other sizes only can be in no link. A bucket deals its classes
    to as many groups as there are buckets, one row for each, so that rows do not grow with classes times buckets.
    """
    rest_bits = min(48, KEY_BITS - bucket_bits)
    apart = math.floor(SIZES_PER_DOUBLING * math.log2(den / num)) + 1

    def run(table: pa.Table) -> pa.Table:
        lengths = _joined(table, "lengths", "<u4").astype(np.int64)
        key = _joined(table, "low", "<u4").astype(np.int64) | _joined(table, "high", "<u2").astype(np.int64) << 32
        owner = np.repeat(_joined(table, "classes", "<i8"), lengths)
        size = (owner & ((1 << SIZE_BITS) - 1)).astype(np.int16)
        order = np.lexsort((owner, size, key))
        key, owner, size = key[order], owner[order], size[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner, size = key[new], owner[new], size[new]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(start) - 1
        frequency = np.bincount(group)[group]
        near = ~start[1:] & (size[1:] - size[:-1] <= apart)
        live = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        level = np.minimum(np.floor(LEVELS_PER_DOUBLING * np.log2(frequency)), MOST_LEVEL).astype(np.int64)
        bucket = table.column("bucket")[0].as_py()
        token = (level << KEY_BITS | bucket << rest_bits | key)[live]
        owner = owner[live]
        group = (owner >> SIZE_BITS) & ((1 << bucket_bits) - 1)
        order = np.lexsort((owner, group))
        token, owner, group = token[order], owner[order], group[order]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)])
        groups, first = np.unique(group[begin], return_index=True)
        runs, ends = np.concatenate([first, [len(begin)]]), np.concatenate([begin, [len(token)]])
        packed = {"group": pa.array(groups.astype(np.int32)), "classes": binary_array(owner[begin], runs * 8), "lengths": binary_array(np.diff(ends).astype("<u4"), runs * 4)}
        return pa.table(packed | ({"tokens": binary_array(token, ends[runs] * 8)} if tokens else {}))

    return dealt.groupBy("bucket").applyInArrow(released(run), "group int, classes binary, lengths binary" + ", tokens binary" * tokens)


def _by_class(packed: DataFrame, classes: DataFrame, bucket_bits: int, tokens: bool = True) -> DataFrame:
    """``class, n, live, tokens`` of classes that have live tokens: how many, and which, in order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = _joined(left, "lengths", "<u4").astype(np.int64)
        found, at = np.unique(_joined(left, "classes", "<i8"), return_inverse=True)
        live = np.bincount(at, lengths, len(found)).astype(np.int64)
        known = right.column("class").to_numpy()
        order = np.argsort(known)
        columns = {"class": found, "n": right.column("n").to_numpy()[order[np.searchsorted(known, found, sorter=order)]], "live": live}
        if tokens:
            token = _joined(left, "tokens", "<i8")
            order = np.lexsort((token, np.repeat(at, lengths)))
            columns["tokens"] = list_array(token[order], np.concatenate([[0], np.cumsum(live)]))
        return pa.table(columns)

    group = F.shiftright("class", SIZE_BITS).bitwiseAND(F.lit((1 << bucket_bits) - 1)).cast("int")
    sizes = classes.select("class", "n", group.alias("group"))
    return packed.groupBy("group").cogroup(sizes.groupBy("group")).applyInArrow(released(run), "class long, n long, live long" + ", tokens array<long>" * tokens)


def _need(n: str, num: int, den: int) -> Column:
    """Smallest overlap of a set of ``n`` with any set that it links with."""
    return F.expr(f"({n} * {num} + {den - 1}) div {den}")


def _candidates(dealt: DataFrame, classes: DataFrame, bucket_bits: int, num: int, den: int) -> DataFrame:
    """``class, n, tokens, take`` of classes whose prefix holds a live token. Shingles without a partner come first in a prefix; ``take`` live ones follow."""
    whole = _by_class(_live_tokens(dealt, bucket_bits, num, den), classes, bucket_bits)
    return whole.withColumn("take", (F.col("live") - _need("n", num, den) + 1).cast("int")).where("take > 0").select("class", "n", "tokens", "take")


def _list_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``TOKENS`` values of a list column, and one row at least."""
    for batch in batches:
        offsets, at = batch.column(column).offsets.to_numpy(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOKENS, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def _prefix_rows(sets: DataFrame) -> DataFrame:
    """A row for each live token of a prefix: ``token, class, n, live, at`` and the parity bitmap of the class's live tokens."""
    words = [f"b{k}" for k in range(BITMAP_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _list_slices(batches, 2):
            take = batch.column(3).to_numpy()
            offsets, tokens = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            live = np.diff(offsets)
            bits = np.zeros((batch.num_rows, BITMAP_WORDS), np.uint64)
            row = np.repeat(np.arange(batch.num_rows), live)
            used = tokens[offsets[0] : offsets[-1]]
            np.bitwise_xor.at(bits, (row, (used >> 6) & (BITMAP_WORDS - 1)), np.uint64(1) << (used & 63).astype(np.uint64))
            owner = np.repeat(np.arange(batch.num_rows), take)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
            columns = [tokens[offsets[owner] + at], batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner], live[owner].astype(np.int32), at.astype(np.int32), *bits[owner].T.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["token", "class", "n", "live", "at", *words])

    return sets.select("class", "n", "tokens", "take").mapInArrow(run, "token long, class long, n long, live int, at int, " + ", ".join(f"{w} long" for w in words))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``class, comp`` of every end of ``edges`` (``u, v``): the smallest end reachable, by alternating large and small stars."""

    def stored(df: DataFrame) -> tuple[DataFrame, bool]:
        """The edges, and whether they are stars: every upper end has one edge and is no lower end."""
        rows = materialize(df.where("u != v").distinct(), name)
        ends = rows.select(F.col("u").alias("end"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(rows.select(F.col("v").alias("end"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unsettled = ends.groupBy("end").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        return rows, unsettled.agg(F.count(F.lit(1))).head()[0] == 0

    edges, stars = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while not stars:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges, stars = stored(small)
    return edges.select(F.col("u").alias("class"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("class"), F.col("v").alias("comp")).distinct())


def _suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of how many tokens are in one of the sorted arrays only, exact enough to prune beyond ``most``."""
    differ = abs(len(x) - len(y))
    if depth == 0 or differ > most or not len(x) or not len(y):
        return differ
    middle = y[len(y) // 2]
    cut_y, cut_x = len(y) // 2, int(np.searchsorted(x, middle))
    found = cut_x < len(x) and x[cut_x] == middle
    left = _suffix_bound(x[:cut_x], y[:cut_y], most, depth - 1)
    if left > most:
        return left
    return left + (not found) + _suffix_bound(x[cut_x + found :], y[cut_y + 1 :], most - left, depth - 1)


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``x, y``) that link. The many-sided ``y`` meets its tokens first, so that a token array of ``x`` never travels with every pair."""
    left = pairs.join(sets.select(F.col("class").alias("y"), F.col("n").alias("yn"), F.col("tokens").alias("yt")), "y")
    both = left.join(sets.select(F.col("class").alias("x"), F.col("n").alias("xn"), F.col("tokens").alias("xt")), "x").select("x", "y", "xn", "yn", "xt", "yt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * num
            sets = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(4), batch.column(5))]
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for o, v in sets)
                need = -(-int(total[i]) // (num + den))
                most = len(x) + len(y) - 2 * need
                if most < 0 or _suffix_bound(x, y, most, SUFFIX_DEPTH) > most:
                    continue
                found = np.searchsorted(x, y)
                found[found == len(x)] = 0
                good[i] = np.count_nonzero(x[found] == y) >= need
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["x", "y"])
        release()

    return both.mapInArrow(run, "x long, y long")


def _fits(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and bitmap filter of two prefix rows of one token.

    The bitmaps hold the parity of how many tokens fall on a bit, so bits that differ are no more than tokens in one set only.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    live, other = F.col(f"{a}.live"), F.col(f"{b}.live")
    rest = F.least(live - F.col(f"{a}.at"), other - F.col(f"{b}.at"))
    need = F.expr(f"(({a}.n + {b}.n) * {num} + {num + den - 1}) div {num + den}")
    differ = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(BITMAP_WORDS)), F.lit(0))
    return (n * den >= m * num) & (m * den >= n * num) & ((F.least(f"{a}.at", f"{b}.at") + rest) * (num + den) >= (n + m) * num) & (live + other - differ >= 2 * need)


def _meets_first(a: str, b: str, num: int, den: int) -> Column:
    """Whether the token is the first that two prefixes share, so that a pair meets once; and what is left of both from there on can be enough."""
    rest = F.least(F.col(f"{a}.live") - F.col(f"{a}.at"), F.col(f"{b}.live") - F.col(f"{b}.at"))
    return (rest * (num + den) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * num) & ~F.arrays_overlap(f"{a}.earlier", f"{b}.earlier")


def link_classes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``class, comp`` of classes that link with another one, from ``class, n, tokens, take``.

    Classes meet on prefix tokens under the length and positional filters. In star rounds each token's classes are compared with one
    of them only, unless both are already in one component; which loses nothing, since pairs left out are linked
    through others. When few pairs between components are left, or a round has settled few of them, all of those are compared, each pair on the
    first token that both prefixes have. Each pair is verified once.
    """
    prefix = materialize(_prefix_rows(sets), "prefix")
    shared = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    prefix = materialize(prefix.join(shared.drop("k"), "token"), "prefix")
    rows = prefix.count()
    links = tested = joined = before = None
    for turn in range(STAR_ROUNDS + 1):
        if joined is None:
            placed = prefix.withColumns({"comp": F.col("class"), "rank": F.xxhash64("class")})
            last = False
        else:
            degree = links.select(F.explode(F.array("x", "y")).alias("class")).groupBy("class").agg((-F.count(F.lit(1))).alias("rank"))
            known = joined.join(degree, "class", "left")
            placed = prefix.join(known, "class", "left").withColumns({"comp": F.coalesce("comp", "class"), "rank": F.coalesce("rank", F.lit(0))})
            placed = materialize(placed, "placed")
            split = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count(F.lit(1)).alias("c")).where("c > 1")
            left = split.agg(F.sum(F.col("k") * F.col("k") - F.col("kk")) / 2).head()[0] or 0
            if not left:
                break
            last = left <= PAIRS_LEFT * rows or turn == STAR_ROUNDS or (before is not None and left > (1 - SETTLED) * before)
            before = left
            placed = placed.join(split.select("token"), "token")
            prefix = placed.drop("comp", "rank")
        if last:
            largest = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).alias("_l")).select("token", F.col("_l.comp").alias("large"))
            tokens = sets.select(F.col("class").alias("_class"), F.col("tokens").alias("_tokens"))
            placed = materialize(placed.join(tokens, F.col("class") == F.col("_class")).withColumn("earlier", F.slice("_tokens", 1, F.col("at"))).drop("_class", "_tokens"), "placed")
            few = placed.join(largest, "token").where("comp != large")
            a, b = few.alias("a"), placed.alias("b")
            once = (F.col("b.comp") == F.col("a.large")) | (F.col("a.class") < F.col("b.class"))
            found = b.join(a, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & once & _fits("a", "b", num, den) & _meets_first("a", "b", num, den))
        else:
            pivots = placed.groupBy("token").agg(F.min(F.struct("rank", "class", "n", "live", "at", "comp", *[f"b{k}" for k in range(BITMAP_WORDS)])).alias("p")).select("token", "p.*")
            a, b = pivots.alias("a"), placed.alias("b")
            found = b.join(a, (F.col("a.token") == F.col("b.token")) & (F.col("a.class") != F.col("b.class")) & (F.col("a.comp") != F.col("b.comp")) & _fits("a", "b", num, den))
        pairs = found.select(F.col("a.class").alias("x"), F.col("b.class").alias("y"), F.least("a.class", "b.class").alias("lo"), F.greatest("a.class", "b.class").alias("hi")).dropDuplicates(["lo", "hi"])
        if tested is not None:
            pairs = pairs.join(tested, ["lo", "hi"], "left_anti")
        pairs = materialize(pairs, "pairs")
        good = materialize(verify(pairs.select("x", "y"), sets, num, den), "links")
        tested = pairs.select("lo", "hi") if tested is None else tested.unionByName(pairs.select("lo", "hi"))
        links = good if links is None else links.unionByName(good)
        edges = good.select(F.col("x").alias("u"), F.col("y").alias("v"))
        if joined is not None:
            edges = edges.unionByName(joined.select(F.col("class").alias("u"), F.col("comp").alias("v")))
        joined = components(edges)
        if last:
            break
    return joined


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Documents link when intersection times ``den`` is at least ``num`` times union of their sets of ``words``-word shingles. ``component_id`` is the smallest
    id that links reach. Null, empty and blank texts have no shingles, link with nothing and are their own component. Equal sets are one class, met once;
    rows that repeat an id are in the component of their own text. Shingles and sets are told apart by
    hashes (a set's has 55 bits beside its size's level, a shingle's 51 to 56 in comparisons, by the number of buckets). No pair of classes that could link is left out.
    """
    spark = docs.sparkSession
    table = materialize(_documents(docs, words, id_col, text_col), "shingled")
    total = table.agg(F.sum("n")).head()[0] or 0
    bucket_bits = max(1, math.ceil(math.log2(max(total / BUCKET, partitions(spark)))))
    sizes = table.where("n > 0").groupBy("class").agg(F.first("n").alias("n"))
    sizes = materialize(sizes, "classes")
    chosen = _screened(docs, words, sizes, bucket_bits, text_col, num, den)
    sets = materialize(_candidates(_deal(docs, words, bucket_bits, text_col, chosen=chosen), sizes, bucket_bits, num, den), "sets")
    joined = link_classes(sets, num, den)
    classes = table.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("_least"))
    placed = classes.join(joined, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least = placed.groupBy("comp").agg(F.min("_least").alias("component_id"))
    ids = materialize(placed.join(least, "comp").select("class", "component_id"), "components")
    return table.join(ids, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
