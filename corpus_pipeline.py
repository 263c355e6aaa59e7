"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, SentencePiece ids.

Each stage works on all that the one before it kept, and is an operator of tidemark.llm with its production parameters. Nulls,
empty and long texts, ties, repeated rows, empty tables and extra columns are treated as each operator's docstring says; of
rows that repeat a doc_id and a text near dedup leaves one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, line_join, minmax_dedup, piece_codec, quality_classifier
from tidemark.llm.common import cut, recorded, release

_left: list[str] = []  # folders of intermediate tables of the stage before


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stage(f):
    """A stage's result is written before the next stage begins, which therefore deletes what the one before left on its way, unless its docs still read it."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left, docs)
        with recorded(_left):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, for low quality or toxicity, go."""
    return quality_classifier.accept(docs, _table(spark, sf_dir, "labels"))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; so do documents of which nothing is left."""
    return line_join.dedup_lines(docs, width=5, percent=80)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return minmax_dedup.dedup(docs, width=5, percent=80)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to."""
    import public_tokenizers

    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "n_tokens", "ids", "decoded"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("token_ids", token_ids)]

#: The classifier and the encoder can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each is written and read again, as the next reads its input more than once."""
    docs, before = _table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            written: list[str] = []
            with recorded(written):
                docs = cut(docs, name)
            release(spark, before)
            before = written
    return docs
