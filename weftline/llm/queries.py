"""The pN_ queries of the subpackage, each with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import boilerplate, consensus, language, leakage, packing, pii, quality, repetition, splits
from weftline.llm.oracles import ORACLES
from weftline.session import table

KEY = b"test tables only"  # the queries' key; a caller brings their own
Query = Callable[[SparkSession, str], DataFrame]


def _p1_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.identified(table(spark, d, "build_a"), table(spark, d, "sampled_text"), table(spark, d, "stop_words"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = _p1_languages(spark, d).select("id", "languages")
    wrong = language.mislabelled(table(spark, d, "build_a"), found).join(p6_found(spark, d), "id", "left_anti")
    return wrong.select("id", F.explode("languages").alias("found_lang")).distinct()


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    found = _p1_languages(spark, d)
    return found.select("id", F.concat_ws(",", F.array_sort("languages")).alias("languages"), F.round("confidence", 6).alias("confidence")).distinct()


def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = _p1_languages(spark, d).select("id", F.explode(F.arrays_zip("starts", "ends", "passage_languages", "confidences")).alias("p"))
    return rows.select("id", F.col("p.starts").alias("start"), F.col("p.ends").alias("end"), F.col("p.passage_languages").alias("lang"), F.round("p.confidences", 6).alias("confidence")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_hosts(splits.assign_splits(table(spark, d, "build_label_dataset")))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    return splits.host_groups(splits.assign_splits(table(spark, d, "build_label_dataset")))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    components = splits.assign_splits(table(spark, d, "build_label_dataset"))
    return components.where("node not like 'of:%'")


def p2_incremental(spark: SparkSession, d: str) -> DataFrame:
    """All labels in two batches by their time (those without one in the second): the table after both, by split."""
    rows = table(spark, d, "build_label_dataset")
    middle = F.lit("2025-01-01").cast("timestamp_ntz")
    early = F.coalesce(F.col("labelled_at") < middle, F.lit(False))
    first = splits.persist(splits.assign_splits(rows.where(early)))
    return splits.split_shares(splits.assign_splits(rows.where(~early), spark.read.parquet(first)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "apply_filters")).select("page_id", "line_no")


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.line_report(table(spark, d, "apply_filters"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_repeated_lines(table(spark, d, "apply_filters"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive_pages(table(spark, d, "apply_filters")).select("page_id")


def p4_outliers(spark: SparkSession, d: str) -> DataFrame:
    return repetition.outlying_pages(table(spark, d, "apply_filters")).select("page_id")


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = repetition.repetition_statistics(table(spark, d, "apply_filters"))
    share = F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(0.0)
    return stats.select("page_id", "words", F.round(share, 6).alias("repeated_share"), "excess", "top").dropDuplicates()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    documents, _ = consensus.consensus(table(spark, d, "build_label_dataset"))
    return documents.where("annotators >= 3").select("doc_id", "label")


def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    _, annotators = consensus.consensus(table(spark, d, "build_label_dataset"))
    return annotators


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.alpha(table(spark, d, "build_label_dataset"))


def _p6_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(table(spark, d, "build_a"), table(spark, d, "stop_words"), table(spark, d, "sampled_text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(_p6_verdicts(spark, d)).select("id").distinct()


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = quality.quality_statistics(table(spark, d, "build_a"), table(spark, d, "stop_words"))
    return stats.select("id", *(F.round(s, 6).alias(s) for s in quality.STATISTICS)).distinct()


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return _p6_verdicts(spark, d).select("id", "class").distinct()


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_sequences(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(packing.packed_sequences(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "held_out"))
    return leakage.leaks(found).select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "held_out"))


def _p9_detector(spark: SparkSession, d: str) -> pii.Detector:
    """Words that open sentences but are no names: those that the clean samples write in lower case, and the common words."""
    words = F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, r"[.,!?]+$", ""))
    plain = table(spark, d, "sampled_text").select(F.explode(words).alias("word")).where(F.lower("word") == F.col("word"))
    return pii.detector_for(table(spark, d, "name_list"), plain.union(table(spark, d, "stop_words").select("word")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.located(table(spark, d, "documents"), _p9_detector(spark, d), KEY).where("surrogate is not null").select("doc_id", "line_no", "kind").distinct()


def p9_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return pii.rewritten(table(spark, d, "documents"), _p9_detector(spark, d), "surrogate", KEY).distinct()


def p9_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return pii.rewritten(table(spark, d, "documents"), _p9_detector(spark, d), "placeholder", KEY).distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_languages, p1_passages, p2_found, p2_members, p2_splits, p2_incremental, p3_found, p3_lines, p3_clean, p4_found, p4_outliers, p4_statistics, p5_found, p5_annotators, p5_agreement, p6_found, p6_statistics, p6_classes, p7_sequences, p7_report, p8_found, p8_overlaps, p9_found, p9_surrogates, p9_placeholders)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
