"""The pipeline on the smallest tables, stage by stage."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from carrierscan.llm import jaccard
from carrierscan.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    rows = [("start", spark.read.parquet(f"{SF}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        rows.append((name, materialize(stage(spark, rows[-1][1], SF), name)))
    return dict(rows)


def test_stages_keep_columns_and_only_drop(stages):
    columns = stages["start"].columns
    sizes = [stages[n].count() for n in ("start", "toxicity", "language", "near_duplicates")]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert all(stages[n].columns == columns for n in ("toxicity", "language", "near_duplicates", "mixing"))


def test_one_of_each_group_stays(stages):
    left = stages["near_duplicates"]
    again = jaccard.jaccard_components(left, 5, 80, 100)
    assert again.where("doc_id != component_id").count() == 0
    first = jaccard.jaccard_components(stages["language"], 5, 80, 100)
    assert {r[0] for r in first.select("component_id").distinct().collect()} == {r[0] for r in left.select("doc_id").collect()}


def test_mix_and_pack_carry_every_copy(stages):
    copies = Counter(r["doc_id"] for r in stages["mixing"].select("doc_id").collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in stages["near_duplicates"].select("doc_id").collect()}
    firsts = Counter(r["doc_id"] for r in stages["packing"].where("piece = 0").select("doc_id").collect())
    assert firsts == copies
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in stages["near_duplicates"].select("text").collect())
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in stages["mixing"].select("text").collect())
    assert abs(taken - 1.5 * words) < 0.05 * words


def test_null_and_repeated_ids_are_documents_like_others(spark):
    def text(name, last=""):
        return " ".join(f"{name}{i}" for i in range(60)) + last

    rows = [
        (None, text("alone"), "clean without a copy"),
        (None, text("none"), "group of null ids"), (None, text("none", " x"), "group of null ids"), (None, text("none"), "group of null ids"),
        (7, text("same"), "copies of one id"), (7, text("same"), "copies of one id"), (7, text("same", " y"), "copies of one id"),
        (9, text("mixed"), "null beside an id"), (None, text("mixed"), "null beside an id"), (8, text("mixed", " z"), "null beside an id"),
        (7, text("other"), "another text of a repeated id"), (11, text("last"), "plain"),
    ]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, kind string"), SF)
    assert left.columns == ["doc_id", "text", "kind"]
    got = sorted((r["kind"], r["doc_id"]) for r in left.collect())
    assert got == [("another text of a repeated id", 7), ("clean without a copy", None), ("copies of one id", 7), ("group of null ids", None), ("null beside an id", 8), ("plain", 11)]


def test_filters_keep_clean_documents_and_drop_the_others(spark, tmp_path):
    """Toxic, foreign and letterless documents go; clean ones stay, the short, long and repeated ones too, with all their columns."""
    import random

    r = random.Random(3)
    english, german = ("river stone garden window market teacher winter summer morning letter".split(), "strasse fenster morgen winter garten lehrer brief sommer wasser schule".split())
    bad = ["vilescum", "rotfilth", "slurword"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice((english, german)[i % 2]) for _ in range(40)]
        if i % 9 == 0:
            words[10:10] = bad
        rows.append((i, " ".join(words), ("en", "de")[i % 2], "clean" if i % 9 else "toxic"))
        labels += [(i, int(i % 9 == 0))] * (i < 300)
    rows += [(500, "river garden", "en", "clean"), (501, " ".join(english * 4000), "en", "clean"), (502, rows[1][1], "de", "clean"), (502, rows[1][1], "de", "clean"), (None, rows[3][1], None, "clean")]
    rows += [(510, None, "en", "letterless"), (511, "", None, "letterless"), (512, "12 34 !!", "en", "letterless"), (513, "zzqx qqzzx xxqzq zxqqz " * 10, None, "foreign")]
    docs = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, lang string, kind string, Toxic_Pred int, lang_pred int, size int, _row int")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}")
    assert clean.columns == docs.columns
    assert Counter(x["kind"] for x in clean.collect()) == {"clean": 360, "letterless": 3, "foreign": 1}
    known = corpus_pipeline.keep_known_languages(spark, clean, "")
    assert Counter(tuple(x)[3:] for x in known.collect()) == {("clean", 1, 2, 3, 4): 360}
    assert corpus_pipeline.mix(spark, known.withColumn("source", known["lang"]), "").columns == [*docs.columns, "source"]
    assert Counter(tuple(x)[4:] for x in corpus_pipeline.drop_near_duplicates(spark, known, "").collect()).keys() == {(1, 2, 3, 4)}


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, SF)
        assert got.count() == 0 and (name == "packing" or got.columns == none.columns)
