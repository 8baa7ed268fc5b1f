"""The queries of this subpackage: each applies its operator to its whole table and derives the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trees, divergence, jaccard_join, language_id, lexical_search, line_dedup, packing, quality_classifier, quality_rules, token_files, url_filter, warc, webp
from .common import fold, shared_path, table


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # the archives were written just now: a gap would be a lost page, and fails the query
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "archive", F.col("offset").cast("string"), "reason"))
    records = records.where(F.when(F.col("kind") == "gap", lost.cast("boolean")).otherwise(True))
    return records.select(F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removals(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), params=line_dedup.DedupParams(passages=False)))  # the rule of its SQL


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's default, as the pipeline uses it: with passages of short sentences and scripts without blanks."""
    return _removals(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _removals(out: DataFrame) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["length"], s["kept_in"]))
    return out.select(
        "doc_id",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["length"]).alias("chars_removed"),
        F.array_join(spans, ",").alias("removed_spans"),
        F.length("text").cast("bigint").alias("chars_left"),
        F.md5("text").alias("text_md5"),
    )


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[c.split()[0] for c in webp.MEDIA_SCHEMA.split(", ")])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    params = quality_classifier.ClassifierParams()
    model = quality_classifier.learn(docs, quality_classifier.quality_labels(table(spark, sf_dir, "labels")), params)
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def op7_bpe_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_trees.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    n = (F.octet_length("ids") / 4).cast("bigint")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    judged = url_filter.filter_urls(pages, url_filter.labelled_urls(pages, labels))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc_salvage,
        op2_quality_rules,
        op3_packing,
        op4_line_dedup,
        passage_dedup,
        op5_lossless_webp,
        op6_quality_classifier,
        op7_bpe_trees,
        op8_language_id,
        op9_jaccard_join,
        op10_url_rules,
        op11_maxscore_search,
        op12_token_files,
        op13_source_divergence,
    )
    return {f.__name__: f for f in found}
