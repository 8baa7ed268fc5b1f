"""A corpus pipeline: documents to packed token sequences, each stage by one operator of ``casewright.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns they were given.

What holds for every stage: null ids and null texts are rows like others; rows that repeat are judged each (and taken as copies where copies are
sought); columns besides those of ``documents`` are carried untouched, whatever they are called; an empty table gives an empty table.
"""

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from casewright.llm.common import bounded_batches, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = "__carried"


def carrying(stage: Stage) -> Stage:
    """A stage that sees the columns of ``documents`` alone; others go through it as one struct, so that no name can clash with the stage's own.

    Stages follow each other in the same executors, and so take texts in small batches.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        extra = [c for c in docs.columns if c not in DOCUMENTS]
        if not extra:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*[c for c in docs.columns if c in DOCUMENTS], F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(extra)]).alias(CARRIED))
        places = {c: f"{CARRIED}.c{k}" for k, c in enumerate(extra)}
        return stage(spark, packed, sf_dir).select(*[F.col(places.get(c, c)).alias(c) for c in docs.columns])

    return run_stage


@carrying
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts have the share of good labels as their score. Without labels of both kinds every score is that share, so all stay or
    all go together. Long texts are scored whole, block by block. Ties don't occur: a document is judged by itself.
    """
    params = quality_classifier.ClassifierParams()
    model = quality_classifier.learn(docs, quality_classifier.quality_labels(table(spark, sf_dir, "labels")), params)
    return quality_classifier.score(docs, model).where(F.col("score") >= params.threshold).select(*docs.columns)


@carrying
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose whole host is rejected, go.

    Null and empty texts have no word and so fail. A null source is no host: its documents are judged by the base rules alone.
    """
    return quality_rules.quality_rules(docs, keep=docs.columns).where("kept").select(*docs.columns)


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the smallest id.

    Texts without a word link with nothing and stay, as do rows without an id. Of rows that repeat an id one stays.
    """
    return jaccard_join.keep_first(docs)


@carrying
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of lines, sentences and passages go from their texts; ``n_chars`` follows.

    The earliest occurrence stays, by id and then place, a null id last. Null texts stay null. No document goes, also where nothing of its text is left.
    """
    out = line_dedup.dedup_lines(docs)
    return out.select(*[F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row for each piece. A null or empty text is its end token alone."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("jaccard_join", near_duplicates), ("line_dedup", repeated_lines), ("packing", pack)]

#: Compression sizes and token ids can't be had in SQL; ``tests/llm/test_pipeline.py`` holds the whole chain against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
