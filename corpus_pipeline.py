"""A training corpus from ``documents``: toxic texts go, texts of no known language go, near duplicates go, sources are mixed, texts are packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.llm import jaccard, langid, mixing, packing, toxicity
from carrierscan.llm.common import materialize
from carrierscan.llm.queries import tokenizer

#: A text of which less than this share of n-grams fits any known language is in none of them.
LEAST_LANGUAGE_SCORE = 0.3


def apart(docs: DataFrame, *added: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns renamed whose names an operator adds, in upper or lower case, and the columns under their old names."""
    own = {c: f"_own{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in added}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents, scores every one, and drops those predicted toxic.

    Null and empty texts have no evidence and stay; rows that repeat or tie are judged each by its text; an empty table stays empty.
    """
    rows, columns = apart(docs, "toxic_score", "toxic_pred", "toxic_passages")
    model = toxicity.fit_toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(rows, model).where("toxic_pred = 0").select(*columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those that read like none of the languages.

    Rows that repeat are judged each by its text; without any language to learn, every document goes.
    """
    rows, columns = apart(docs, "lang_pred", "lang_score")
    named = langid.predict_languages(rows, langid.fit_languages(rows))
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles at 0.8 join, one row stays: that with the smallest id, null ids last, and any one of those that repeat it.

    Rows are told apart by an own number, so that null and repeated ids count as documents like all others. A document without shingles (null, empty, blank) is a group of its own.
    """
    rows, columns = apart(docs, "_row")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = jaccard.jaccard_components(rows, words=5, num=80, den=100, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first")
    kept = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(first).select(F.col("first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: 0 to 2 times. Null sources are one source; texts without words take part with their source's rate for size 0."""
    rows, columns = apart(docs, "size", "source_size", "target", "copies", "_copy")
    return mixing.mix_sources(rows).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; a document that the mix takes twice is there twice. Null and empty texts are an end mark alone."""
    return packing.packed_digests(docs, **tokenizer())


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: Trained models, links and token ids are beyond SQL: links, mix and packing are tested against brute-force versions, the two filters on documents of known kinds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
