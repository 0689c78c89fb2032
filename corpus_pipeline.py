"""A training corpus from the ``documents`` table: five stages, each an operator of ``relomap.llm``.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``:

1. ``language_id``: texts without letters, or without a language that holds a share of them, go.
2. ``quality``: texts that the quality classifier predicts 0 go.
3. ``line_dedup``: lines that repeat an earlier line, a few edits aside, are taken out; documents left empty go.
4. ``ngram_dedup``: of documents linked by n-gram similarity the one with the least id stays.
5. ``packing``: what remains is packed into token sequences; one row per piece.

Defined cases, for all stages: a null text is no text of any language, so its row goes in the first stage; stages that see
one nevertheless treat it as empty (``line_dedup`` drops it). Rows with null or repeated ids are documents like any other,
told apart by their texts; rows equal in id and text stay together in the first three stages and become one in
``ngram_dedup``. Ties go to the least id, ids before nulls, then to the least hashes of the texts. Of very long texts all
words count. Empty tables give empty results. Further columns are passed on as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relomap.llm.catalogue import tokenizer_path
from relomap.llm.common import forget, free_name, written
from relomap.llm.langid import UNKNOWN, fit_language, identify_language
from relomap.llm.line_dedup import remove_repeated_lines
from relomap.llm.ngram_join import keep_first
from relomap.llm.packing import PackOptions, pack_documents
from relomap.llm.quality import fit_quality, score_quality
from relomap.tables import forget_since, tables_so_far

#: Least mean posterior of a text's language; below it no language holds the text.
LEAST_LANGUAGE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language; the model is learned from this stage's own documents with a known one."""
    pred, score = free_name("lang_pred", docs.columns), free_name("lang_score", docs.columns)
    found = identify_language(docs, fit_language(docs, F.lit(True)), pred_col=pred, score_col=score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of predicted quality 0; the model is learned from ``labels`` and this stage's documents."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score, predicted = free_name("quality_score", docs.columns), free_name("quality_predicted", docs.columns)
    return score_quality(docs, model, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts, and drop documents of which nothing is left."""
    left = remove_repeated_lines(docs).where(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return keep_first(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    return pack_documents(docs, PackOptions(tokenizer=tokenizer_path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("ngram_dedup", ngram_dedup),
    ("packing", packing),
]

#: The stages learn models, so SQL cannot express the pipeline; tests/llm checks it against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the ``documents`` table; what a stage has written for itself goes when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = tables_so_far()
        after = written(spark, stage(spark, docs, sf_dir), name)
        forget_since(spark, mark, after)
        forget(spark, docs)
        docs = after
    return docs
