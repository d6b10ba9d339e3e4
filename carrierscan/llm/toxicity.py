"""Toxic passages as maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierscan.llm.common import materialize, text_slices, with_text_columns

#: Labelled rows of each class and fold that a model is fitted on at most, chosen by the hash of their ids.
SAMPLE_ROWS = 10_000
#: The Dirichlet prior counts for this share of the labelled documents, dealt by each token's share of them.
PRIOR_SHARE = 0.02
LEAST_Z, LEAST_ODDS, LEAST_DOCUMENTS = 2.5, 1.5, 4
#: Score of a token without evidence; a passage keeps going over about twenty of them for one strong token.
NEUTRAL = -0.3
#: Lengths of the token beginnings that stand for tokens of one stem.
STEMS = (5, 4)
#: Null segments below this score do not count for the tail.
TAIL_FROM = 1.5
CACHE_ENTRIES = 200_000
TOKEN = re.compile(r"[^\W\d_]+")
#: Different tokens and stems that a task counts before it passes them on.
FLUSH = 200_000
PASSAGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])


@dataclass(frozen=True)
class ToxicityModel:
    """``odds`` by token or stem (``abcd*``); ``rate`` and ``scale`` of the null segments' tail; ``weights`` of the final logistic."""

    odds: dict[str, float]
    rate: float = 1.0
    scale: float = 1.0
    weights: tuple[float, float, float] = (0.0, 1.0, 0.0)


def maximal_segments(at: np.ndarray, gains: np.ndarray, neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a sequence in time linear in its positive tokens.

    ``at`` and ``gains`` are places and scores of the positive tokens; every other token scores ``neutral``. Each new positive token is
    joined with earlier segments while that gives more than the segments alone. A segment remembers the nearest earlier one that begins
    lower; a search jumps along these links, so that no segment is passed twice.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []  # running sum before the segment
    high: list[float] = []  # and after it
    link: list[int] = []
    total, end = 0.0, -1
    for place, gain in zip(at.tolist(), gains.tolist(), strict=True):
        total += neutral * (place - end - 1)
        start, begin = place, total
        total, end = total + gain, place
        j = len(first) - 1
        while j >= 0 and low[j] >= begin:
            j = link[j]
        while j >= 0 and high[j] < total:
            start, begin, below = first[j], low[j], link[j]
            for column in (first, last, low, high, link):
                del column[j:]
            j = below
        for column, value in ((first, start), (last, end), (low, begin), (high, total), (link, j)):
            column.append(value)
    return [(a, b, right - left) for a, b, left, right in zip(first, last, low, high, strict=True)]


def token_scorer(odds: dict[str, float]):
    """Scores of tokens: the token's own or its stem's log-odds, the higher; ``NEUTRAL`` for others."""
    cache: dict[str, float] = {}

    def score(tokens: list[str]) -> np.ndarray:
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for token in [t for t in set(tokens) if t not in cache]:
            cache[token] = max([odds.get(token, NEUTRAL), *(odds.get(token[:n] + "*", NEUTRAL) for n in STEMS if len(token) > n)])
        return np.fromiter(map(cache.__getitem__, tokens), np.float64, len(tokens))

    return score


def document_segments(text: str, scorer) -> tuple[int, list[tuple[int, int, float]]]:
    tokens = TOKEN.findall(text.lower())
    scores = scorer(tokens)
    at = np.flatnonzero(scores > 0)
    return len(tokens), maximal_segments(at, scores[at], NEUTRAL) if len(at) else []


def evidence(n: int, segments: list[float], rate: float, scale: float) -> tuple[float, float]:
    """Minus the logarithm of the best segment's E-value, and of how many segments fewer than one is expected by chance."""
    if not segments:
        return -10.0, 0.0
    logs = [rate * s - math.log(scale * max(n, 1)) for s in segments]
    return min(max(max(logs), -10.0), 30.0), math.log1p(sum(x > 0 for x in logs))


def _sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Different texts of at most about ``rows`` labelled documents of each class and fold: ``y, fold, text``; of copies with several labels and folds, the least."""
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(4)), F.lit(2))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"), fold.cast("int").alias("fold"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, 2 * rows / n))) for y, n in sizes.items()], F.lit(0.0))
    chosen = materialize(known.where(draw < share), "labels")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    small = F.broadcast(chosen) if chosen.count() <= 8 * rows else chosen
    once = texts.join(small, "_id").groupBy(F.xxhash64("text")).agg(F.min(F.struct("y", "fold", "text")).alias("_one"))
    return once.select("_one.y", "_one.fold", "_one.text")


def _odds(counts: DataFrame, totals: dict[tuple[int, int], int], folds: tuple[int, ...]) -> dict[str, float]:
    """Scores of tokens with significant log-odds for class 1 in the given folds, under an informative Dirichlet prior.

    A score is the log-odds less one standard error of the toxic count, so that rare tokens count for less.
    """
    y1, y0 = (sum((F.col(f"n{y}{f}") for f in folds), F.lit(0)) for y in (1, 0))
    d1, d0 = (max(1, sum(totals.get((y, f), 0) for f in folds)) for y in (1, 0))
    weight = PRIOR_SHARE * (d1 + d0)
    prior = F.lit(PRIOR_SHARE) * (y1 + y0)
    k1, k0 = y1 + prior + 1e-6, y0 + prior + 1e-6
    odds = F.log(k1 / (d1 + weight - k1 + 1e-6)) - F.log(k0 / (d0 + weight - k0 + 1e-6))
    error = F.sqrt(1 / k1 + 1 / k0)
    rows = counts.where(y1 >= LEAST_DOCUMENTS).select("token", (odds - F.sqrt(1 / k1)).alias("score"), odds.alias("odds"), (odds / error).alias("z"))
    return {r["token"]: r["score"] for r in rows.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).select("token", "score").collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn token log-odds from labelled texts, and calibrate passages on texts that their log-odds have not seen.

    Counts are of documents with a token; copies of a text count once. Two models, each of one fold, score the other fold: null segments of class 0
    give the exponential tail of scores (rate, and scale per token), and a logistic turns a document's evidence into a
    probability. The driver gets the significant tokens and three numbers for each sampled text. Labels without a text, and other labels than 0 and 1, teach nothing; with one class only, no text is toxic.
    """
    sample = materialize(_sample(docs, labels, rows, id_col, text_col, label_col), "toxic-sample")
    totals = {(r["y"], r["fold"]): r["n"] for r in sample.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({y for y, _ in totals}) < 2:
        return ToxicityModel({}, weights=(-3.0, 0.0, 0.0))
    cells = [f"n{y}{f}" for y in (0, 1) for f in (0, 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in cells]
        for batch in text_slices(batches):
            for y, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(TOKEN.findall(text.lower()))
                held[2 * y + fold].update(words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS)))
            if sum(map(len, held)) >= FLUSH:
                yield _counted(held, cells)
                held = [Counter() for _ in cells]
        yield _counted(held, cells)

    tokens = sample.select("y", "fold", "text").mapInArrow(count, "token string, " + ", ".join(f"{c} long" for c in cells))
    counts = materialize(tokens.groupBy("token").agg(*[F.sum(c).alias(c) for c in cells]).where("n10 + n11 >= 2"), "tokens")
    halves = [_odds(counts, totals, (f,)) for f in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [token_scorer(shared.value[1 - f]) for f in (0, 1)]
        for batch in text_slices(batches):
            folds = batch.column(1).to_pylist()
            found = [document_segments(t, scorers[f]) for t, f in zip(batch.column(2).to_pylist(), folds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for *_, s in segs] for _, segs in found], pa.list_(pa.float64()))], names=["y", "n", "scores"])

    seen = materialize(sample.select("y", "fold", "text").mapInArrow(segments, "y int, n long, scores array<double>"), "segments")
    tail = F.filter("scores", lambda s: s > TAIL_FROM)
    null = seen.where("y = 0").agg(F.sum(F.size(tail)).alias("k"), F.sum(F.aggregate(tail, F.lit(0.0), lambda a, s: a + s - TAIL_FROM)).alias("over"), F.sum("n").alias("n")).head()
    rate = (null["k"] + 1) / (null["over"] + 1.0)
    scale = (null["k"] + 1) * math.exp(rate * TAIL_FROM) / (1 + null["n"])
    chance = F.log(F.lit(scale) * F.greatest("n", F.lit(1))) / rate
    rows = seen.select("y", (rate * (F.array_max("scores") - chance)).alias("best"), F.size(F.filter("scores", lambda s: s > chance)).alias("few")).toArrow()
    best = np.nan_to_num(np.array(rows.column("best").to_pylist(), np.float64), nan=-10.0).clip(-10.0, 30.0)
    x = np.stack([np.ones(len(best)), best, np.log1p(rows.column("few").to_numpy())], axis=1)
    return ToxicityModel(_odds(counts, totals, (0, 1)), rate, scale, tuple(_logistic(x, rows.column("y").to_numpy().astype(float))))


def _counted(held: list[Counter], cells: list[str]) -> pa.RecordBatch:
    tokens = sorted(set().union(*held))
    return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), *(pa.array([c[t] for t in tokens], pa.int64()) for c in held)], names=["token", *cells])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score_texts(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default) with ``toxic_score, toxic_pred, toxic_passages``, from whole texts.

    Passages are the maximal segments of which fewer than one is expected by chance in a text of that length, as token numbers (``end`` after the last). Null and
    empty texts score as texts without evidence. Columns named like the added ones, in upper or lower case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list = []

    def score(texts: list[str | None]) -> list[pa.Array]:
        model = shared.value
        if not scorers:
            scorers.append(token_scorer(model.odds))
        scores, passages = [], []
        for text in texts:
            n, segments = document_segments(text or "", scorers[0])
            x = evidence(n, [s for *_, s in segments], model.rate, model.scale)
            scores.append(1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * x[0] + model.weights[2] * x[1]))))
            expected = [(a, b + 1, s, model.scale * max(n, 1) * math.exp(-model.rate * s)) for a, b, s in segments]
            passages.append([dict(zip(("start", "end", "score", "e_value"), p, strict=True)) for p in expected if p[3] < 1])
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, pa.list_(PASSAGE))]

    added = {"toxic_score": "double", "toxic_pred": "int", "toxic_passages": "array<struct<start int, end int, score double, e_value double>>"}
    return with_text_columns(docs, score, added, keep, text_col)
