"""Language labels by a pluggable identifier, and how they differ from given ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import tokens

PREFIX = 3000  # fixed value: characters that an identifier is given
Identifier = Callable[[list[str]], tuple[list[str | None], list[float]]]


def by_common_words(docs: DataFrame, stop_words: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, label, prob): the language with the most common words among the first PREFIX characters, and its share of them.

    Ties go to the first label; a text without common words has no label and probability 0. The list of common words
    is the small side of the join; what is shuffled are counts.
    """
    words = docs.select(id_col, F.explode(tokens(F.substring(F.coalesce(text, F.lit("")), 1, PREFIX))).alias("w"))
    stops = stop_words.select(F.col("lang").alias("_lang"), F.lower("word").alias("w")).distinct()
    hits = words.join(stops, "w").groupBy(id_col, "_lang").agg(F.count("*").alias("n"))
    best = hits.groupBy(id_col).agg(F.min_by("_lang", F.struct(-F.col("n"), "_lang")).alias("label"), F.max("n").alias("best"), F.sum("n").alias("total"))
    return docs.select(id_col).join(best, id_col, "left").select(id_col, "label", F.round(F.coalesce(F.col("best") / F.col("total"), F.lit(0.0)), 4).alias("prob"))


def by_model(docs: DataFrame, load: Callable[[], Identifier], id_col: str, text: str) -> DataFrame:
    """(id, label, prob) by any identifier; ``load`` runs once a task, the identifier takes texts of one line of PREFIX characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            labels, probs = model([(t or "")[:PREFIX].replace("\n", " ") for t in b["_t"]])
            yield pd.DataFrame({id_col: b[id_col], "label": labels, "prob": probs})

    slim = docs.select(id_col, F.col(text).alias("_t"))
    return slim.mapInPandas(run, f"{id_col} {slim.schema[id_col].dataType.simpleString()}, label string, prob double")


def confusion(rows: DataFrame, theirs: str, ours: str) -> DataFrame:
    """(theirs, ours, n) of rows whose two labels differ in their first three letters; a missing label is ''."""
    a, b = F.coalesce(theirs, F.lit("")), F.coalesce(ours, F.lit(""))
    return rows.where(F.substring(a, 1, 3) != F.substring(b, 1, 3)).groupBy(a.alias("theirs"), b.alias("ours")).agg(F.count("*").alias("n"))
