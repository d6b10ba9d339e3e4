"""The ten training-data operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrierscan.llm import ann, gif, jaccard, langid, mixing, packing, queries, sharding, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, shard string, score string, _extra int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(seed=0, n=60):
    """Texts with exact copies, near copies, nulls, empties, blanks, one long text and one repeated row."""
    r = random.Random(seed)
    rows = []
    base = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(120)]
    for i in range(n):
        words = [r.choice(WORDS) + str(r.randrange(400)) for _ in range(r.randrange(1, 90))]
        if i % 5 == 0:
            words = list(base)
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"edit{r.randrange(1000)}"
        rows.append([i, " ".join(words), "en", f"src{i % 3}"])
    rows[1][1], rows[2][1], rows[3][1], rows[4][1] = None, "", " \t\n", "One  two"
    rows[6][1] = "one\ttwo"
    rows[7][3] = None
    rows[8][1] = " ".join(f"w{j % 977}x{j}" for j in range(20_000))
    rows[9][1] = rows[11][1]
    rows.append(list(rows[12]))
    return [(*x, "clash", "clash", 7) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# nearest neighbours


def vectors():
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=16) * (1 + i % 3)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(25)]
    return rows + [(900, None), (901, [0.0] * 16), (902, [math.nan] + [1.0] * 15), (903, [None] + [1.0] * 15), (20, rows[20][1]), (904, [math.inf] + [1.0] * 15), (905, [1.0, 2.0]), (920, [2.0, 1.0]), (906, [])]


def test_nearest_recall_and_ties(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), block_rows=150, query_rows=10).collect()
    good = {i: np.array(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = Counter()
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(abs(s - float(good[q] @ good[i])) < 1e-9 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        found["hit"] += len({i for _, i in best} & {m[1] for m in mine})
        found["all"] += len(best)
    assert found["hit"] >= 0.9 * found["all"]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_counts_of_bitmaps():
    r = np.random.default_rng(5)
    for m in (1, 2, 3, 5, 17, 64):
        member = r.random((4, m, 128)) < 0.6
        sets = np.packbits(member, axis=-1, bitorder="little").view(np.uint64)
        for need in {1, m // 2 + 1, m, m + 1, 2 * m + 9}:
            got = np.unpackbits(ann.at_least(sets.copy(), need).view(np.uint8), axis=-1, bitorder="little").astype(bool)
            assert (got == (member.sum(axis=1) >= need)).all()


def test_few_vectors_are_verified():
    """Recall and the share of verified vectors on points without clusters, the hardest case, against brute force."""
    v = np.random.default_rng(7).normal(size=(8000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    index = ann.CollisionIndex(v, 1.0)
    asked = np.arange(0, 8000, 100)
    found = index.search(v[asked], [np.array([i]) for i in asked], 20)
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = -2
    hit = sum(len(set(np.argsort(-s)[:20].tolist()) & set(rows.tolist())) for s, (rows, _) in zip(scores, found, strict=True))
    assert hit >= 0.9 * 20 * len(asked)
    assert index.verified < 0.2 * v.shape[0] * len(asked)


def test_registered_search_finds_the_nearest_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = queries.op1_collision_ann(spark, sf).collect()
    ids = np.array(sorted(rows))
    every = np.array([rows[i] for i in ids])
    hit = 0
    for q in ids[ids % 20 == 0]:
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        scores = every @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        assert len(mine) == 20 and all(abs(s - rows[q] @ rows[i]) < 1e-12 for i, s in mine.items())
        hit += len(set(best) & set(mine))
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


# WARC


PAGES = [(i, f"http://a/{i}", "<p>" + "x" * (i % 4 * 60) + str(i % 7) + "</p>") for i in range(40)] + [(50, None, None), (51, "http://b\r\nX: y", ""), (None, "u", "q" * 300), (60, "u", "q" * 300), (3, "http://a/3", "é" * 80)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(warc.mark_revisits(pages), sample_bytes=2000, archive_bytes=3000)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(PAGES) == sum(r["records"] for r in manifest.collect())
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= 100 and first.get(html or "") is not None and i != first[html or ""]
        want[(None if i is None else str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(first[html]) if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["record_type"] == "revisit" or hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archive_layout(spark, tmp_path):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(concat('<li>', id % 17, '</li>'), 20) as html").coalesce(1)
    row = warc.write_archives(warc.mark_revisits(pages, least=10**9), f"file://{tmp_path}").collect()[0]
    data = open(row["path"].removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    assert data[8 + size : 12 + size] == b"\x28\xb5\x2f\xfd"
    assert row["records"] == 300 and row["bytes"] == len(data)


# URL rules


def test_rules_and_cascade(spark):
    urls = ["http://a.com/en/1", "https://EXAMPLE.com/en/77?x", "http://example.com/en/8", "ftp://x.example.net/de/81#t", "http://net/de/", "com/en/", None, "", "http://", "http://xcom/en/1", "http://a.org", "http://b.org/es/", "a://b://c.com/en/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, verdict string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    want = [judge(u) for u in urls]
    for bound in (urlfilter.FILTER_BYTES, 1):
        got = urlfilter.judge_urls(df, queries.URL_RULES, most_bytes=bound).orderBy("page_id").collect()
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == want
    assert urlfilter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert urlfilter.judge_urls(df, []).where("rule is null").count() == len(urls)


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("_one"), F.xxhash64("id", F.lit(1)).alias("_two"), (F.col("id") % 7 == 0).alias("_listed"))
    levels = urlfilter.build_cascade(keys.select("_one", "_two"), keys.where("_listed").unionByName(keys.select((F.col("_one") + 1).alias("_one"), "_two", "_listed").limit(5)), rate=0.3)
    table = keys.toPandas()
    assert len(levels) > 2
    assert (urlfilter.is_member(levels, table["_one"].to_numpy(), table["_two"].to_numpy()) == table["_listed"].to_numpy()).all()


# toxicity


def test_segments_match_brute_force():
    r = random.Random(3)
    for _ in range(200):
        scores = [r.choice([-0.3, -0.3, -0.3, 1.0, 2.5, 0.7]) for _ in range(r.randrange(1, 25))]

        def best(a, b):
            """Maximal scoring segments: the best segment, then those of both sides."""
            options = [(sum(scores[i : j + 1]), i - j, -i, i, j) for i in range(a, b) for j in range(i, b)]
            top = max(options, default=None)
            if not top or top[0] <= 1e-12:
                return []
            return [*best(a, top[3]), (top[3], top[4]), *best(top[4] + 1, b)]

        at = np.flatnonzero(np.array(scores) > 0)
        got = toxicity.maximal_segments(at, np.array(scores)[at], -0.3)
        assert sum(s for *_, s in got) == pytest.approx(sum(sum(scores[a : b + 1]) for a, b in best(0, len(scores))))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((sum(scores[a : b + 1]) for a, b in best(0, len(scores))), default=0))


def test_segments_take_time_linear_in_the_positives():
    n = 300_000
    for gap, gains in ((50, np.ones(n)), (1, np.full(n, 0.2)), (2, np.random.default_rng(0).exponential(0.3, n))):
        began = time.process_time()
        assert toxicity.maximal_segments(np.arange(n) * gap, gains, -0.3)
        assert time.process_time() - began < 10


def test_toxicity_learns_and_handles_gaps(spark):
    r = random.Random(5)
    bad = ["slur" + x for x in ("aa", "bb", "cc", "dd", "ee")]
    rows = [(i, " ".join([r.choice(WORDS) + str(r.randrange(50)) for _ in range(60)] + ([r.choice(bad) for _ in range(4)] if i % 5 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame([*rows, (700, None), (701, ""), (702, "slurzz slurqq slurxx " * 4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, model).collect()}
    assert len(got) == 603 and all(0 <= r["toxic_score"] <= 1 for r in got.values())
    assert sum(got[i]["toxic_pred"] == int(i % 5 == 0) for i in range(400, 600)) >= 195
    assert got[700]["toxic_pred"] == got[701]["toxic_pred"] == 0 and got[702]["toxic_pred"] == 1
    assert toxicity.score_texts(docs, toxicity.fit_toxicity(docs, labels.limit(0))).where("toxic_pred = 1").count() == 0
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


# packing


def test_plan_is_tight_and_complete():
    r = random.Random(2)
    for capacity in (10, 64):
        lengths = Counter(r.randrange(1, capacity + 1) for _ in range(500))
        room, seen = {}, Counter()
        for length, a, b, first, offset in packing.plan_slots(dict(lengths), capacity):
            for k in range(a, b):
                room.setdefault(first + k - a, []).append((offset, length))
                seen[length] += 1
        assert seen == lengths
        for slots in room.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(room) <= -(-sum(k * v for k, v in lengths.items()) // capacity) * 1.1 + 1


def test_pieces_are_the_tokenizer_s(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer()["tokenizer_path"])
    got = packing.pack_documents(docs, capacity=128, **queries.tokenizer()).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for row in docs.collect():
        ids = [*tok.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[row["doc_id"]], key=lambda r: r["piece"])
        twice = 2 if row["doc_id"] == 12 else 1
        assert b"".join(p["ids"] for p in pieces[::twice]) == struct.pack(f"<{len(ids)}I", *ids)
        assert [p["start"] for p in pieces[::twice]] == list(np.cumsum([0, *(p["length"] for p in pieces[::twice])])[:-1])
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in fill.values():
        assert sum(n for _, n in slots) <= 128 and sorted(o for o, _ in slots) == list(np.cumsum([0, *(n for _, n in sorted(slots))])[:-1])
    assert packing.pack_documents(none, **queries.tokenizer()).count() == 0


def test_both_encoders_agree():
    from tokenizers import Tokenizer

    names = queries.tokenizer()
    tok = Tokenizer.from_file(names["tokenizer_path"])
    texts = ["a  b   c", " lead", "trail ", "tab\t x \ty", "it's  we'll don't", "<|endoftext|> x <|endoftext|>", "\xa0 \u2003 y", "new\n line \n\n z", "日本 語 é", "a \x1c b", "", " ", "x" * 5000, "½ ² Ⅷ ١٢ a1b2", "e\u0301\u200b\ufeff", "🙂🏽 z"]
    for encode in (packing.text_ids(names["tokenizer_path"]), packing.text_ids(names["tokenizer_path"], names["ranks"], names["pattern"])):
        for text, ids in zip(texts, encode(texts), strict=True):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_blank_runs_and_failures_of_the_fast_encoder_give_the_tokenizers_ids(monkeypatch):
    from tokenizers import Tokenizer

    names = queries.tokenizer()
    tok = Tokenizer.from_file(names["tokenizer_path"])
    encode = packing.text_ids(names["tokenizer_path"], names["ranks"], names["pattern"])
    texts = ["a" + " " * 1_200_000 + "b", "short text", "\n" * 1_200_000, ("word " * 30_000) + " " * 99_999 + "end"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(struct.unpack(f"<{len(ids) // 4}I", ids)) for ids in encode(texts)] == want

    class Panic(BaseException):
        pass

    class Failing:
        def encode_ordinary(self, text):
            raise Panic

    tokenizer, special, _ = packing._encoders(names["tokenizer_path"], names["ranks"], names["pattern"])
    monkeypatch.setattr(packing, "_encoders", lambda *_: (tokenizer, special, Failing()))
    encode = packing.text_ids(names["tokenizer_path"], names["ranks"], names["pattern"])
    assert list(struct.unpack(f"<{len(want[1])}I", encode(texts[1:2])[0])) == want[1]


# language


def test_languages(spark):
    r = random.Random(4)
    parts = {"xx": ["bla", "kro", "zim"], "yy": ["ting", "shol", "wen"]}
    rows = [(i, " ".join("".join(r.choice(parts[("xx", "yy")[i % 2]]) for _ in range(3)) for _ in range(30)), ("xx", "yy")[i % 2]) for i in range(200)]
    docs = spark.createDataFrame([*rows, (300, None, "xx"), (301, "", "yy"), (302, "123 !!", None), (303, "Bla" * 2000, None)], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs.where("doc_id % 4 != 2"))
    got = {r["doc_id"]: r for r in langid.predict_languages(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 303)] == ["und", "und", "und", "xx"]
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    empty = langid.fit_languages(docs.where("lang is null"))
    assert langid.predict_languages(docs, empty).where("lang_pred != 'und'").count() == 0


def test_masks_hold_every_language(spark):
    grams = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slices = np.zeros(1 << 14, np.uint8)
    for place in langid._places(grams, len(slices)):
        np.bitwise_or.at(slices, place, (np.arange(1000) % 3 + 1).astype(np.uint8))
    model = langid.LanguageFilter(("a", "b"), (slices,), np.zeros(2))
    assert ((model.masks(grams)[0] & (np.arange(1000) % 3 + 1)) == np.arange(1000) % 3 + 1).all()


def brute_grams(text):
    """Character 3- and 4-grams of a lower-cased text, in which a run of other characters than letters is one blank."""
    line = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip(" ") + " "
    return Counter(line[i : i + n] for n in langid.SIZES for i in range(len(line) - n + 1) if " " not in line[i + 1 : i + n - 1])


def test_grams_of_texts_cut_in_parts(monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("aabbcd e.1\n") for _ in range(r.randrange(400))) for _ in range(20)] + ["", "x" * 900, " . "]
    for part in (langid.PART, 64, 7):
        monkeypatch.setattr(langid, "PART", part)
        got = [Counter() for _ in texts]
        for value, owner in langid.text_grams(texts):
            for v, o in zip(value.tolist(), owner.tolist(), strict=True):
                got[o][v] += 1
        assert [sorted(c.values()) for c in got] == [sorted(brute_grams(t).values()) for t in texts]


def test_more_languages_than_a_mask_holds(spark):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02d}": ["".join(r.choice(letters) for _ in range(6)) for _ in range(6)] for i in range(70)}
    rows = [(70 * k + i, " ".join(r.choice(w) for _ in range(25)), lang) for k in range(6) for i, (lang, w) in enumerate(words.items())]
    docs = spark.createDataFrame([(i, t, x, "old") for i, t, x in rows], "doc_id long, text string, lang string, Lang_Pred string")
    got = langid.predict_languages(docs, langid.fit_languages(docs.where("doc_id < 350")))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    assert got.where("doc_id >= 350 and lang = lang_pred").count() == 70


def test_a_very_long_text_has_a_language(spark):
    docs = spark.createDataFrame([(i, ("ting shol wen " if i % 2 else "bla kro zim ") * (300_000 if i > 9 else 20), "yy" if i % 2 else "xx") for i in range(12)], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs.where("doc_id < 10"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs, model, ["doc_id"]).collect()} == {i: "yy" if i % 2 else "xx" for i in range(12)}


# GIF


def test_gif_round_trip_and_rules():
    r = np.random.default_rng(0)
    for n in (576, 576 * 3, 576 * 40):
        for data in (r.integers(0, 256, n, np.uint8).tobytes(), bytes(n), (b"the quick brown fox " * n)[:n]):
            frames = list(gif.decode_gif(gif.encode_gif(data, frame_rows=16)))
            assert b"".join(f["samples"] for f in frames) == data
            assert [f["at_ms"] for f in frames] == [100 * i for i in range(len(frames))]
            assert sum(frames[0]["histogram"][:8]) == frames[0]["width"] * frames[0]["height"]
    for size in range(2, 9):
        data = r.integers(0, 1 << size, 5000, np.uint8).tobytes()
        assert gif.lzw_unpack(gif.lzw_pack(data, size), size, len(data)) == data
    with pytest.raises(gif.GifError):
        list(gif.decode_gif(b"GIF89a"))


def build_gif(frames, w=2, h=2):
    """A four-colour GIF from (samples, left, top, width, height, disposal, transparent or -1, interlace)."""
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for samples, left, top, fw, fh, disposal, transparent, interlace in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent >= 0), 5, max(transparent, 0)) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, fw, fh, 0x40 if interlace else 0) + b"\x02" + gif._blocks(gif.lzw_pack(bytes(samples), 2))
    return out + b"\x3b"


def test_disposal_transparency_interlace():
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)

    def shown(data):
        return [[tuple(f["pixels"][i : i + 4]) for i in range(0, 16, 4)] for f in gif.decode_gif(data, pixels=True)]

    assert shown(build_gif([([1] * 4, 0, 0, 2, 2, 1, -1, False), ([2, 0], 0, 0, 2, 1, 2, 0, False), ([3], 1, 1, 1, 1, 0, -1, False)])) == [[red] * 4, [green, red, red, red], [clear, clear, red, blue]]
    assert shown(build_gif([([1] * 4, 0, 0, 2, 2, 1, -1, False), ([2] * 4, 0, 0, 2, 2, 3, -1, False), ([3], 0, 0, 1, 1, 0, -1, False)])) == [[red] * 4, [green] * 4, [blue, red, red, red]]
    rows = [0, 1, 2, 3, 0, 1, 2, 3, 1]
    order = [i for a, s in gif.PASSES for i in range(a, 9, s)]
    assert list(next(iter(gif.decode_gif(build_gif([([rows[i] for i in order], 0, 0, 1, 9, 0, -1, True)], 1, 9))))["samples"]) == rows


def test_media_columns(docs, none):
    media = gif.text_media(docs)
    got = gif.decode_frames(media).collect()
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    for r in got:
        payload = b"".join(f["samples"] for f in r["frames"])
        assert len(payload) % 576 == 0 and payload and not payload[r["n_bytes"] :].strip(b"\xff")
        texts[(r["doc_id"], payload[: r["n_bytes"]])] -= 1
    assert not any(texts.values())
    assert gif.text_media(none).count() == 0
    assert gif.decode_frames(media.limit(1).withColumn("media", F.lit(b"no gif"))).collect()[0]["frames"] is None


# Jaccard join


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(text or "", "utf8").lower())
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_components_match_brute_force(docs, k, num):
    rows = docs.collect()
    sets = {r["doc_id"]: shingles(r["text"], k) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = jaccard.jaccard_components(docs, k, num, 100).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(s), find(i)) for i, s in sets.items()}
    assert len({find(i) for i in sets}) < len(sets)


def test_components_of_few_rows(spark, none):
    assert jaccard.jaccard_components(none).count() == 0
    one = spark.createDataFrame([(5, "a b"), (2, "A  b"), (9, None)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.jaccard_components(one).collect()} == {(5, 1, 2), (2, 1, 2), (9, 0, 9)}


def test_chains_of_links_are_one_component(spark):
    words = [f"w{i}" for i in range(300)]
    chain = []
    for i in range(12):
        chain.append((100 - i, " ".join(words)))
        words[i * 20] = f"other{i}"
        words[i * 20 + 9] = f"third{i}"
    got = jaccard.jaccard_components(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {89}


# sharding


def test_shards_are_even_and_whole(docs, none):
    rows = docs.collect()
    got = sharding.shard_documents(docs, shards=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    small = docs.where("doc_id != 8")
    size = Counter()
    for r in sharding.shard_documents(small, shards=4).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 4 and max(size.values()) - min(size.values()) <= 3 * max(len((r["text"] or "").encode()) + 8 for r in small.collect())
    assert sharding.shard_documents(none).count() == 0


def test_a_large_group_of_copies_is_cut(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('copy ', 20), concat('own ', id, repeat(' x', 40))) as text")
    size = {r["shard"]: r["n"] for r in sharding.shard_documents(df, shards=6).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert max(size.values()) < 1.02 * sum(size.values()) / 6


# mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark, docs, none):
    r = random.Random(9)
    rows = [(i, "w " * r.choice([0, 1, 5, 20, 200]), None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}") for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target = brute_targets(sizes)
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == sizes[s] and mine[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["size"] * r["copies"] for r in mine) - target[s]) <= 3
    again = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}
    assert mixing.mix_sources(docs).count() == docs.count()
    assert mixing.mix_sources(none).count() == 0


def test_rates_are_tilted_and_bounded(spark):
    cells = spark.createDataFrame([("0a", s, 10) for s in (1, 10, 100, 1000)], "_key string, _size long, _n long")
    targets = spark.createDataFrame([("0a", 11110, 9000.0)], "_key string, source_size long, target double")
    dual = mixing.balance(cells, targets)
    row = cells.join(dual, "_key").withColumn("r", mixing._rate(2)).orderBy("_size").collect()
    assert sum(r["_n"] * r["_size"] * r["r"] for r in row) == pytest.approx(9000, rel=1e-6)
    logs = [math.log(r["r"]) / r["_size"] for r in row]
    assert max(logs) - min(logs) < 1e-12
