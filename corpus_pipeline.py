"""A corpus pipeline: quality rules, toxicity, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.line_dedup import dedup_lines
from panelforge.llm.ngram_join import one_of_each_group
from panelforge.llm.packing import pack
from panelforge.llm.quality import quality_verdicts
from panelforge.llm.queries import model_path
from panelforge.llm.shared import free_name, materialize, table
from panelforge.llm.toxicity import learn, score_documents


def _without(docs: DataFrame, gone: DataFrame, *key: Column) -> DataFrame:
    """docs without the rows whose key is in the columns of gone."""
    names = [free_name(f"{k}", docs.columns) for k in range(len(key))]
    gone = gone.distinct().toDF(*names)
    return docs.join(gone, reduce(lambda x, y: x & y, [k == F.col(n) for k, n in zip(key, names)]), "left_anti")


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified thresholds reject go; a verdict is on a text and its language, whatever the doc_id."""
    verdicts = quality_verdicts(docs, table(spark, sf_dir, "labels"), version=True)
    return _without(docs, verdicts.where("not kept").select("version", "stratum"), _version(), F.coalesce(F.col("lang").cast("string"), F.lit("none")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; a score is of a text, whatever the doc_id."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select(_version().alias("doc_id"), "text"), model)
    return _without(docs, materialize(scored.where("score >= 0.5").select("doc_id").distinct(), "toxic"), _version())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. A document may end up empty."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, model_path("byte_bpe_50k.json"), model_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Learning a toxicity model, SimHash and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
