"""A corpus pipeline: language identification, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes and reads again as the
next stage's docs. All but the last return the columns of documents. A removal is a small or large list of
row keys (id and text): up to ``BROADCAST_IDS`` of them are broadcast, so that documents stay where they are; beyond
that the documents are shuffled by key.

Defined results: rows with a null or letterless text are rejected by the first stage; rows are judged one by one, so
rows of one id or without one stay or go by their own text; of rows with equal id and text one passes the second
stage; an empty table gives an empty result; other columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signal_engine.llm import decontaminate, langid, ngram_join, packing
from signal_engine.llm.common import Scratch

BROADCAST_IDS = 1_000_000
#: Python workers pass from stage to stage, so each stage's caches and slices are small; no result depends on them.
CACHE_WORDS, SLICE_BYTES = 60_000, 1 << 19
#: Rows that the Parquet reader decodes at once: its buffers of whole texts and token sets are in the executor's heap.
READ_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "256"}
#: Rows sent to a Python worker at once, where texts are handled one by one.
SMALL = {**READ_ROWS, "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


KEY = "_corpus_pipeline_row_key"


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs (with KEY) without the keys in removed, a written table."""
    if removed.count() <= BROADCAST_IDS:
        removed = F.broadcast(removed)
    return docs.join(removed, KEY, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language learned from the labelled ones."""
    model = langid.fit(docs.where(~langid.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    kept = langid.keep_languages(docs, model, cache_words=CACHE_WORDS, slice_bytes=SLICE_BYTES)
    return Scratch(spark, "language-id", settings=SMALL).write(kept, "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of documents linked by a shingle similarity of 0.8 or more."""
    scratch = Scratch(spark, "near-duplicates", settings=READ_ROWS)
    rows = scratch.write(ngram_join.group_rows(docs, scratch, slice_bytes=SLICE_BYTES), "rows")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("first_row"))
    copies = scratch.write(rows.where(~stays).select(F.col("row").alias(KEY)).distinct(), "copies")
    kept = without(docs.withColumn(KEY, ngram_join.row_key()), copies)
    repeated = scratch.write(rows.where(stays).groupBy(F.col("row").alias(KEY)).count().where("count > 1").select(KEY), "repeated")
    if repeated.head(1):
        once = kept.join(repeated, KEY, "left_semi").dropDuplicates([KEY])
        kept = without(kept, repeated).unionByName(once)
    return kept.drop(KEY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    scratch = Scratch(spark, "decontamination", settings=READ_ROWS)
    keyed = docs.withColumn(KEY, ngram_join.row_key())
    found = decontaminate.find_matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch, id_col=KEY)
    return without(keyed, scratch.write(found.select(KEY).distinct(), "leaks")).drop(KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, Scratch(spark, "pack", settings=SMALL), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, cache_words=CACHE_WORDS, slice_bytes=SLICE_BYTES)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: SQL can't express the language model or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
