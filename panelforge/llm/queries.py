"""One query for each operator, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.additive_index import nearest
from panelforge.llm.html_extract import extract_pages
from panelforge.llm.license_scan import scan_licenses
from panelforge.llm.line_dedup import line_report
from panelforge.llm.ngram_join import jaccard_groups
from panelforge.llm.packing import pack
from panelforge.llm.quality import QUALITY_SQL, quality_verdicts
from panelforge.llm.sentencepiece_dropout import sp_encode
from panelforge.llm.shared import materialize, table
from panelforge.llm.sharding import range_shards
from panelforge.llm.toxicity import learn, score_documents


def model_path(name: str) -> str:
    """A vocabulary file of the machine's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded with merge-dropout and decoded again: ids, their checksum, and whether the text came back."""
    model = model_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = sp_encode(docs, model, dropout=0.1, seed=1, keep=["doc_id"], lossless="lossless")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "lossless")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their license phrases and the license templates that their blocks contain."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the lines that fuzzy deduplication drops."""
    return line_report(table(spark, sf_dir, "documents"))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of 1024 tokens by lexical retrieval."""
    return pack(table(spark, sf_dir, "documents"), model_path("byte_bpe_50k.json"), model_path("byte_bpe_50k.tiktoken"))


def op5_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 8 shards of nearly equal bytes; equal texts stand side by side."""
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    return range_shards(materialize(slim, "slim"), ["text_key", "doc_id"], "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range_id"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents scored for toxicity, by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents judged by base rules and by rules with certified thresholds, learned from labels."""
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their group by shingle similarity."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op9_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to each one whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_dropout": op1_sentencepiece_dropout,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_retrieval_packing": op4_retrieval_packing,
    "op5_range_shards": op5_range_shards,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_join": op8_ngram_join,
    "op9_additive_neighbours": op9_additive_neighbours,
    "op10_html_extraction": op10_html_extraction,
}

JACCARD_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
g as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
l as (
  select a.doc_id as a, b.doc_id as b from g a join g b on a.s = b.s and a.doc_id <> b.doc_id
  group by 1, 2 having 100 * count(*) >= 80 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))),
r(doc_id, c) as (select doc_id, doc_id from w union select l.b, r.c from r join l on r.doc_id = l.a)
select doc_id, any_value(coalesce(n, 0))::bigint as n_shingles, min(c) as component_id from r left join n using (doc_id) group by doc_id"""

ORACLES: dict[str, str] = {"op7_quality_rules": QUALITY_SQL, "op8_ngram_join": JACCARD_SQL}
