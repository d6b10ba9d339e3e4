"""Each registered query on the smallest tables, against a plain version of its contract; and columns with clashing names."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from carrierscan.llm import gif, langid, mixing, packing, queries, sharding, toxicity, urlfilter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op4_scores_every_document(spark, texts):
    got = queries.op4_toxic_segments(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_op4_learns_nothing_from_held_out_labels(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(queries.fold("doc_id", 5) != 0)
    whole = toxicity.score_texts(docs, toxicity.fit_toxicity(docs, labels), ["doc_id"]).select("doc_id", "toxic_score")
    registered = queries.op4_toxic_segments(spark, SF).select("doc_id", F.col("score").alias("toxic_score"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, registered.collect()))


def test_op5_packs_the_tokenizer_s_ids(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer()["tokenizer_path"])
    got = defaultdict(list)
    place = defaultdict(list)
    for r in queries.op5_best_fit_packing(spark, SF).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(texts)
    total = 0
    for i, row in texts.items():
        ids = [*tok.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        count = -(-len(ids) // 1024)
        ends = [len(ids) - 1024 * (count - 1 - k) for k in range(count)]
        starts = [0, *ends[:-1]]
        want = [(k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
        assert sorted(got[i]) == want
    for slots in place.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(place) <= math.ceil(total / 1024) * 1.02 + 1


def test_op6_names_languages(spark, texts):
    got = {r["doc_id"]: r for r in queries.op6_language_bitmask(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, row in texts.items():
        assert got[i]["held_out"] == (fold(i, 4) == 2)
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in row["text"] or ""))
    held = [i for i in texts if got[i]["held_out"] and got[i]["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == texts[i]["lang"] for i in held) >= 0.95 * len(held)


def test_op7_reads_back_what_it_stored(spark, texts):
    got = {r["doc_id"]: r for r in queries.op7_gif_frames(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, row in texts.items():
        data = (row["text"] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        media = gif.encode_gif(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_op8_and_op9_carry_every_document(spark, texts):
    got = queries.op8_prefix_jaccard(spark, SF).collect()
    sets = {}
    for i, row in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0d]+", (row["text"] or "").encode().lower())
        sets[i] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), find(i)) for i in sets}
    shards = queries.op9_histogram_shards(spark, SF).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in shards) == sorted((i, len((x["text"] or "").encode()) + 8, zlib.crc32((x["text"] or "").encode())) for i, x in texts.items())
    slots = defaultdict(list)
    for r in shards:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op10_takes_near_the_targets(spark, texts):
    got = queries.op10_entropy_mix(spark, SF).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", x["text"] or "")) for i, x in texts.items()}
    assert {(r["doc_id"], r["size"]) for r in got} == set(size.items())
    per, taken, target = Counter(), Counter(), {}
    for r in got:
        s = texts[r["doc_id"]]["source"]
        per[s] += size[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert {s: (taken[s], target[s], per[s]) for s in per if abs(taken[s] - target[s]) > max(10, 0.03 * target[s]) or target[s] > 2 * per[s] + 1e-6} == {}
    assert sum(target.values()) == pytest.approx(min(1.5, 2) * sum(per.values()))


CLASHES = ["_all", "_id", "_key", "_size", "_salt", "_row", "_base", "_n", "_uid", "_keys", "_hit", "_scan", "_before", "_each", "_odd", "_rank", "_block"]


def test_other_columns_stay_whatever_their_names(spark):
    rows = [(1, "hello big world", "a", *range(17)), (None, "hello small world", None, *range(17)), (1, "hello big world", "a", *range(17)), (3, None, "b", *range(17))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), *CLASHES)
    model = langid.fit_languages(docs.withColumn("lang", F.lit("xx")))
    results = [
        sharding.shard_documents(docs, 2), mixing.mix_sources(docs), langid.predict_languages(docs, model), toxicity.score_texts(docs, toxicity.ToxicityModel({})),
        urlfilter.judge_urls(pages, queries.URL_RULES), urlfilter.judge_urls(pages, queries.URL_RULES, most_bytes=1), packing.place_pieces(docs.withColumn("length", F.lit(5).cast("long")), 10),
    ]
    for df in results:
        got = df.collect()
        assert len(got) == 4 and all([r[c] for c in CLASHES] == list(range(17)) for r in got), df.columns
    old = docs.withColumns({"SIZE": F.lit("x"), "Target": F.lit("x"), "lang_PRED": F.lit("x"), "Toxic_Score": F.lit("x"), "Shard": F.lit("x"), "Offset": F.lit("x")})
    assert {type(r["size"]) for r in mixing.mix_sources(old).collect()} == {int} == {type(r["shard"]) for r in sharding.shard_documents(old, 2).collect()}
    assert {type(r["toxic_score"]) for r in toxicity.score_texts(old, toxicity.ToxicityModel({})).collect()} == {float}
    assert {type(r["lang_pred"]) for r in langid.predict_languages(old, model).collect()} == {str}


def test_one_length_of_many_rows_is_packed_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 16)
    df = spark.range(1000).selectExpr("id", "cast(if(id % 10 = 0, id % 7 + 1, 3) as long) as length")
    room = defaultdict(list)
    got = packing.place_pieces(df, 10).collect()
    assert sorted(r["id"] for r in got) == list(range(1000))
    for r in got:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in room.values():
        assert [o for o, _ in sorted(slots)] == [sum(n for _, n in sorted(slots)[:k]) for k in range(len(slots))] and sum(n for _, n in slots) <= 10
