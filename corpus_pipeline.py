"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is one operator of ``cantiga.llm`` at work on what the one before it
kept.  All but the last return the columns of the documents they are given,
extra ones included, whatever their names.  A stage counts and joins by a row
number of its own, so null and repeated ids do no harm; an empty table passes
through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiga.llm import mixing, ngram_join, packing, pu_quality, rules
from cantiga.llm.common import Stored, remainder, table, word_count
from cantiga.llm.queries import MIX_WEIGHTS

#: A document goes when it is likelier bad than good.
LEAST_QUALITY = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _set_apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but doc_id and text under names no operator uses, and these columns' names."""
    inner = [c if c in ("doc_id", "text") else f"__in{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), inner


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[Stored, DataFrame, str]:
    """``docs`` written with a row number, and that column's name."""
    stored, row = Stored(spark, name), "__row"
    while row in docs.columns:
        row = "_" + row
    return stored, stored.keep(docs.withColumn(row, F.monotonically_increasing_id())), row


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose positive-unlabelled quality score is at least one half."""
    rows, names = _set_apart(docs)
    learns = remainder(F.col("doc_id"), 4) != 2
    labels = table(spark, sf_dir, "labels").where(learns)
    scored, _ = pu_quality.score_quality(rows, labels, learns, keep=[c for c in names if c != "doc_id"])
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*names).toDF(*docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rows, names = _set_apart(docs)
    judged, _ = rules.judge(rows, table(spark, sf_dir, "labels"), keep=[c for c in names if c != "doc_id"])
    return judged.where("kept").select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts linked by a similarity of 0.8 or more."""
    _, rows, row = _numbered(spark, docs, "near")
    similar = ngram_join.similar_texts(rows.select(F.col(row).alias("doc_id"), "text"))
    later = similar.where("doc_id != class_id").select(F.col("doc_id").alias(row))
    return rows.join(later, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    _, rows, row = _numbered(spark, docs, "mix")
    mixed = mixing.mix_sources(rows.select(F.col(row).alias("doc_id"), "source", word_count(F.col("text")).alias("size")), F.col("size"), MIX_WEIGHTS)
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("__copies"))
    taken = rows.join(copies, row).withColumn("__copy", F.explode("__copies"))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Learning, similarity search, drawing and tokenizing are not SQL; tests hold a brute-force version against the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again as the next one's input, which then goes."""
    stored = Stored(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored.keep(stage(spark, docs, sf_dir))
        if i:
            stored.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
