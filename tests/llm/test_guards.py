"""Cases that a bound, a hash or a hot group could get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carrierscan.llm import jaccard, langid, sharding, urlfilter


def test_url_hashes_do_not_follow_from_each_other(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "key string")
    one, two = urlfilter.key_hashes(F.col("key"))
    got = rows.select(one.alias("one"), two.alias("two"), F.xxhash64(F.lit(1), one).alias("chained"), F.xxhash64("key", F.lit(1)).alias("folded")).collect()
    assert all(len({r["one"], r["two"], r["chained"], r["folded"]}) == 4 for r in got)


def test_cascade_is_exact_where_one_hash_collides(spark):
    keys = spark.range(3000).select(F.lit(7).cast("long").alias("_one"), F.xxhash64("id").alias("_two"), "id")
    listed = keys.where("id % 10 = 0")
    levels = urlfilter.build_cascade(keys.select("_one", "_two"), listed.select("_one", "_two"))
    found = keys.collect()
    one, two = (np.array([r[c] for r in found], np.int64) for c in ("_one", "_two"))
    assert urlfilter.is_member(levels, one, two).tolist() == [r["id"] % 10 == 0 for r in found]


def test_shards_of_rows_that_repeat_id_and_text_are_even(spark):
    many = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text in every row").alias("text"))
    docs = many.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))).repartition(5)
    got = sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    mean = sum(r["bytes"] for r in got) / 24
    assert len(got) == 24 and sum(r["n"] for r in got) == 9000
    assert all(abs(r["bytes"] - mean) < 0.03 * mean and r["n"] == r["slots"] == r["last"] + 1 for r in got)


@pytest.mark.parametrize("languages", [3, 70])
def test_a_language_filter_of_few_bits_still_tells(spark, monkeypatch, languages):
    monkeypatch.setattr(langid, "MOST_BYTES", 1 << 16)
    words = {f"l{k}": [f"{chr(97 + k % 26)}{chr(97 + (k * 7 + j) % 26)}{chr(97 + (k // 26 * 5 + j * 3) % 26)}{chr(97 + (j * j + k) % 26)}" for j in range(12)] for k in range(languages)}
    rows = [(i, " ".join(words[f"l{i % languages}"][(i + j) % 12] for j in range(60)), f"l{i % languages}") for i in range(languages * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    assert sum(s.nbytes for s in model.slices) <= 1 << 16
    got = langid.predict_languages(docs, model).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)


def test_many_texts_on_one_frequent_passage(spark, monkeypatch):
    """Different texts that share a passage, few of which link: every link is found when the star rounds end at once."""
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    random = np.random.default_rng(6)
    shared = " ".join(f"s{i}" for i in range(12))
    rows = []
    for i in range(160):
        own = [f"w{x}" for x in random.integers(0, 40, 30)] if i % 4 else [f"c{i % 12}x{k}" for k in range(60)]
        if i % 8 == 0:
            own[int(random.integers(0, 60))] = f"u{i}"
        rows.append((i, f"{shared} {' '.join(own)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 2, 70, 100).collect()}
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = set(zip(w, w[1:], strict=False))
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        moved = False
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    least, most = sorted((comp[a], comp[b]))
                    comp = {k: least if v == most else v for k, v in comp.items()}
                    moved = True
        if not moved:
            break
    assert got == comp and len(set(comp.values())) < len(comp) - 10
