"""A pipeline that readies documents for training, as stages of the operators of voxweave.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
documents; the last returns the packed pieces. ``run`` writes each stage's rows to the folder that driver
and executors share, and reads them back as the next one's.

Null texts, empty texts and null columns: language ID drops texts without a letter; a document without
doc_id is kept or dropped by its text like any other. Columns beyond those of documents are passed by.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.llm import decontaminate, language, near, packing, secret_scan
from voxweave.llm.tables import saved, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a text's letters that its main language must have.
MAIN_LANGUAGE = 0.5
#: Characters that the last stage encodes at once, and parts that it keeps, beside executors whose heap the stages before have filled.
PACKED_CHARS, PACKED_PARTS = 1_000_000, 60_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one learned language has at least MAIN_LANGUAGE of the letters; ``und`` goes."""
    docs = docs.select(*COLUMNS)
    model = language.fit(docs)
    out = language.identify(docs, model, COLUMNS)
    return out.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= MAIN_LANGUAGE)).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of the n-gram Jaccard join: that of the smallest doc_id, null last.

    Rows are numbered, so that repeated and missing doc_ids are told apart; ties of doc_id go by the text's
    digest. Rows without a shingle link with nothing and stay. Components are reduced by an aggregate over
    numbers and digests, which meets a hot component by partial sums.
    """
    docs = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    found = near.near_components(docs.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest"), F.col("_row").alias("row"))
    first = docs.select("_row", order.alias("_order")).join(found, "_row").groupBy("component_id").agg(F.min("_order").alias("_least"))
    kept = saved(first.select(F.col("_least.row").alias("_row")))
    return docs.join(small(kept, 48), "_row", "left_semi").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of benchmark; each row is judged by its own text, whatever its doc_id."""
    docs = docs.select(*COLUMNS)
    digest = F.unhex(F.sha2("text", 256)).alias("_digest")
    texts = docs.select(digest.alias("doc_id"), "text")
    found = decontaminate.contained(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_digest")).distinct()
    return docs.select("*", digest).join(small(saved(found), 64), "_digest", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with each secret in its text replaced by a mark, and n_chars counted anew where that was done."""
    rows = secret_scan.scan(docs.select(*COLUMNS))
    hit = F.size("secret_spans") > 0
    text = F.when(hit, secret_scan.redacted(F.col("text"), F.col("secret_spans"))).otherwise(F.col("text"))
    rows = rows.select("doc_id", text.alias("text"), "lang", "source", "n_chars", hit.alias("_hit"))
    return rows.select("doc_id", "text", "lang", "source", F.when(F.col("_hit"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a window of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), chars=PACKED_CHARS, kept=PACKED_PARTS)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("packing", pack_windows),
]

#: SQL has neither the language model nor the tokenizer; tests/llm/test_pipeline.py has a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
