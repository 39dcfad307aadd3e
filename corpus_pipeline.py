"""Cleaning and packing of ``documents`` in five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.common import drop_stage, join_few, write_stage
from stationflow.llm.decontaminate import contamination
from stationflow.llm.language import identify_language
from stationflow.llm.neardup import near_duplicates
from stationflow.llm.packing import pack_documents
from stationflow.llm.quality import resample_quality


# Each stage returns all columns of its documents as they are, whatever their names; an empty table gives no rows.


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` for an operator, and the rest of each row beside them."""
    return docs.select(*columns, F.struct(F.lit(0).alias("none_"), *[c for c in docs.columns if c not in columns]).alias("row_"))


def _columns(docs: DataFrame, *columns: str) -> list[Column]:
    """The columns of ``docs`` again."""
    return [F.col(c) if c in columns else F.col(f"row_.`{c}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null or empty text, no letters, or too near to call.

    Null doc_id: judged by its text. Repeated rows share their fate. A table without any known
    language teaches nothing, so all go.
    """
    return identify_language(_whole(docs, "doc_id", "text", "lang")).filter(~F.col("ambiguous")).select(*_columns(docs, "doc_id", "text", "lang"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling towards good text doesn't select go, and those with null or blank text.

    Null doc_id: judged by its text. Repeated rows share their fate. Ties of the sampling key go to the smaller doc_id. Without labels all
    documents with text stay.
    """
    return resample_quality(_whole(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("selected").select(*_columns(docs, "doc_id", "text"))


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Null doc_id: linked with nothing, so each such row stays. Rows of equal doc_id and text are one
    document, of which one row stays. Null or blank text: like no other, stays. Rows that share a doc_id but not the text are kept or dropped each by its own text.
    """
    found = near_duplicates(docs, text_hash=True).filter("doc_id is not null")
    each = found.groupBy(F.col("doc_id").alias("k_"), F.col("text_hash").alias("h_")).agg(F.max("kept").alias("kept_"), F.count("*").alias("n_"))
    special = write_stage(each.filter("not kept_ or n_ > 1"), "neardup-special")  # the others stay as they are, where they are
    known = _whole(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    mine = (F.col("doc_id") == F.col("k_")) & (F.col("text_hash") == F.col("h_"))
    told = join_few(known, special, mine, F.xxhash64(F.col("doc_id").cast("long"), "text_hash"), F.xxhash64("k_", "h_"), "left")
    once = told.filter("n_ is null")
    often = told.filter("kept_ and n_ > 1").dropDuplicates(["doc_id", "text_hash", "text"])  # only what repeats is shuffled whole
    return once.unionByName(often).select(*_columns(docs, "doc_id", "text"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go.

    Null or empty text: stays. Null doc_id: judged by its text. Repeated rows share their fate. Without benchmark items all stay.
    """
    return contamination(_whole(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(~F.col("contaminated")).select(*_columns(docs, "doc_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences.

    Null or empty text: its end token alone. Null doc_id: packed, with null. Repeated rows: each for itself. Long texts run over many sequences.
    """
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("quality", quality), ("neardup", neardup), ("decontaminate", decontaminate), ("packing", packing)]

#: Learned models and tokenizers can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
