"""Consensus from several annotators' labels (problem 5): confusion matrices and posteriors by expectation-maximisation.

Valid labels: status not void, label 1 to ``classes``, annotator and doc_id not null (annotators are compared in
lower case without outer spaces); of an annotator's several labels on a document the last counts. Votes are
gathered once, one row a document; every iteration is one pass that sends only (annotator, class, label) sums.

An annotator is unreliable if their labels don't follow the document: the agreement of their label with the
estimated true class, corrected for chance (kappa), is under ``least_kappa``. Krippendorff's alpha (nominal) is
reported separately from the model.

Scale: a document's votes are bounded by the annotators. Annotators x classes^2 sums go to the driver, after a
check that there are at most ``most_annotators``; a third of all rows under one annotator is pre-aggregated map-side.
Nulls and ties: see above; equal times take the larger label; a tie among reliable annotators is decided by the
posterior, then the smaller label. Duplicate rows count once. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

VOTES = "doc_id string, annotators array<string>, labels array<int>"


def valid_votes(rows: DataFrame, classes: int = 4, doc_col: str = "doc_id", annotator_col: str = "annotator", label_col: str = "label", status_col: str = "status", time_col: str = "labelled_at") -> DataFrame:
    """(doc_id, annotator, label): the last valid label of each annotator on each document."""
    who = F.lower(F.trim(F.col(annotator_col)))
    slim = rows.select(F.col(doc_col).cast("string").alias("doc_id"), who.alias("annotator"), F.col(label_col).cast("int").alias("label"), F.col(time_col).alias("at"), F.lower(F.trim(F.coalesce(F.col(status_col), F.lit("")))).alias("status"))
    kept = slim.where((F.col("status") != "void") & F.col("label").between(1, classes) & F.col("doc_id").isNotNull() & (F.col("annotator") != ""))
    return kept.groupBy("doc_id", "annotator").agg(F.max(F.struct("at", "label"))["label"].alias("label"))


def packed_votes(votes: DataFrame) -> DataFrame:
    """One row a document: its annotators and their labels."""
    lists = votes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("annotator", "label"))).alias("v"))
    return lists.select("doc_id", F.col("v.annotator").alias("annotators"), F.col("v.label").alias("labels"))


@dataclass
class Model:
    """``confusion[a, k, l]``: probability that annotator a says l of class k; ``prior[k]``; ``kappa[a]``."""

    annotators: list[str]
    confusion: np.ndarray
    prior: np.ndarray
    kappa: np.ndarray
    votes: np.ndarray

    def posterior(self, who: np.ndarray, label: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Class probabilities of documents 0 to n - 1 from their votes."""
        logs = np.tile(np.log(self.prior), (n, 1))
        np.add.at(logs, doc, np.log(self.confusion)[who, :, label])
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(1, keepdims=True)


def _flat(batch: pa.RecordBatch, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, labels = batch.column("annotators"), batch.column("labels")
    sizes = np.diff(names.offsets.to_numpy())
    codes = names.flatten().dictionary_encode()
    who = np.array([index[x] for x in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()] if len(codes) else np.zeros(0, np.int64)
    return who, labels.flatten().to_numpy() - 1, np.repeat(np.arange(batch.num_rows), sizes)


def _expected(batches: Iterator[pa.RecordBatch], model: Model | None, index: dict[str, int], classes: int) -> Iterator[pa.RecordBatch]:
    """A partition's expected counts (annotator, class, label); without a model a document's votes share its class."""
    counts, prior = np.zeros((len(index), classes, classes)), np.zeros(classes)
    for b in batches:
        who, label, doc = _flat(b, index)
        if model is None:
            p = np.zeros((b.num_rows, classes))
            np.add.at(p, (doc, label), 1.0)
            p /= np.maximum(p.sum(1, keepdims=True), 1)
        else:
            p = model.posterior(who, label, doc, b.num_rows)
        for k in range(classes):
            np.add.at(counts, (who, k, label), p[doc, k])
        prior += p.sum(0)
    a, k, l = np.nonzero(counts)
    rows = [np.r_[a, np.full(classes, -1)], np.r_[k, np.arange(classes)], np.r_[l, np.zeros(classes, np.int64)], np.r_[counts[a, k, l], prior]]
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.float64())], ["a", "k", "l", "n"])


def fit(packed: DataFrame, classes: int = 4, smoothing: float = 1.0, iterations: int = 30, tolerance: float = 1e-3, most_annotators: int = 100_000) -> Model:
    """Dawid and Skene's model; ``smoothing`` is added to each cell of a confusion matrix, shared out as the annotator's own labels."""
    names = [r[0] for r in packed.select(F.explode("annotators").alias("a")).distinct().orderBy("a").limit(most_annotators + 1).collect()]
    if len(names) > most_annotators:
        raise ValueError(f"more than {most_annotators} annotators: their matrices don't fit the driver")
    index = {a: i for i, a in enumerate(names)}
    spark = packed.sparkSession
    model: Model | None = None
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast((model, index))
        sums = packed.mapInArrow(lambda it: _expected(it, *sent.value, classes), "a int, k int, l int, n double").groupBy("a", "k", "l").agg(F.sum("n").alias("n")).toPandas()
        counts, prior = np.zeros((len(names), classes, classes)), np.full(classes, smoothing)
        of = sums["a"].to_numpy() >= 0
        counts[tuple(sums.loc[of, ["a", "k", "l"]].to_numpy().T)] = sums.loc[of, "n"]
        prior[sums.loc[~of, "k"].to_numpy()] += sums.loc[~of, "n"].to_numpy()
        new = _maximised(names, counts, prior, smoothing)
        moved = np.inf if model is None else float(np.abs(new.confusion - model.confusion).max(initial=0))
        model = new
        sent.unpersist()
        if moved < tolerance or not names:
            break
    return model


def _maximised(names: list[str], counts: np.ndarray, prior: np.ndarray, smoothing: float) -> Model:
    classes = len(prior)
    said = counts.sum(1) + smoothing
    usual = said / said.sum(1, keepdims=True)
    smooth = counts + smoothing * classes * usual[:, None, :]
    confusion = smooth / smooth.sum(2, keepdims=True)
    total = counts.sum((1, 2)).clip(1e-12)
    true, labels = counts.sum(2) / total[:, None], counts.sum(1) / total[:, None]
    observed, chance = np.trace(counts, axis1=1, axis2=2) / total, (true * labels).sum(1)
    return Model(names, confusion, prior / prior.sum(), (observed - chance) / np.maximum(1 - chance, 1e-9), counts.sum((1, 2)))


def _decide(batches: Iterator[pa.RecordBatch], model: Model, least_kappa: float) -> Iterator[pa.RecordBatch]:
    index = {a: i for i, a in enumerate(model.annotators)}
    good = model.kappa >= least_kappa
    classes = len(model.prior)
    for b in batches:
        who, label, doc = _flat(b, index)
        p = model.posterior(who, label, doc, b.num_rows)
        votes, every = np.zeros((b.num_rows, classes)), np.zeros((b.num_rows, classes))
        np.add.at(votes, (doc, label), good[who].astype(float))
        np.add.at(every, (doc, label), 1.0)
        trusted = votes.sum(1)
        best = np.argmax(np.where(trusted[:, None] > 0, votes, 0) + p * 0.5, 1)  # the posterior decides ties
        n = every.sum(1)
        pairs = n * (n - 1)
        agreement = np.divide((every * (every - 1)).sum(1), pairs, out=np.ones_like(n), where=pairs > 0)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(best + 1, pa.int32()), pa.array(p[np.arange(len(best)), best]), pa.array(n.astype(np.int32)), pa.array(trusted.astype(np.int32)), pa.array(agreement)],
            ["doc_id", "label", "posterior", "annotators", "reliable", "agreement"],
        )


def consensus(rows: DataFrame, classes: int = 4, least_kappa: float = 0.25, **cols: str) -> tuple[DataFrame, DataFrame]:
    """(documents, annotators).

    documents: doc_id, label, posterior, annotators, reliable (of them), agreement (share of agreeing pairs);
    annotators: annotator, votes, kappa, accuracy, reliable.
    """
    packed = cut(packed_votes(valid_votes(rows, classes, **cols)), "votes")
    model = fit(packed, classes)
    documents = packed.mapInArrow(lambda it: _decide(it, model, least_kappa), "doc_id string, label int, posterior double, annotators int, reliable int, agreement double")
    accuracy = (model.prior[None, :] * np.diagonal(model.confusion, axis1=1, axis2=2)).sum(1)
    table = pd.DataFrame({"annotator": model.annotators, "votes": model.votes.round().astype(int), "kappa": model.kappa, "accuracy": accuracy, "reliable": model.kappa >= least_kappa})
    return documents, rows.sparkSession.createDataFrame(table, "annotator string, votes long, kappa double, accuracy double, reliable boolean")


def alpha(rows: DataFrame, classes: int = 4, **cols: str) -> DataFrame:
    """Krippendorff's nominal alpha over documents with two or more votes, by one aggregation: (documents, votes, alpha)."""
    votes = valid_votes(rows, classes, **cols)
    counts = votes.groupBy("doc_id").agg(*(F.sum((F.col("label") == k).cast("long")).alias(f"c{k}") for k in range(1, classes + 1)))
    n = sum((F.col(f"c{k}") for k in range(2, classes + 1)), F.col("c1"))
    paired = counts.withColumn("n", n).where("n >= 2")
    same = sum((F.col(f"c{k}") * (F.col(f"c{k}") - 1) for k in range(2, classes + 1)), F.col("c1") * (F.col("c1") - 1))
    sums = paired.agg(F.count("*").alias("documents"), F.sum("n").alias("votes"), F.sum(same / (F.col("n") - 1)).alias("agree"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(1, classes + 1)))
    met = sum((F.col(f"c{k}") * (F.col(f"c{k}") - 1) for k in range(2, classes + 1)), F.col("c1") * (F.col("c1") - 1))
    expected = F.try_divide(met, F.col("votes") - 1)
    value = F.try_divide(F.col("agree") - expected, F.col("votes") - expected)
    return sums.select("documents", F.coalesce("votes", F.lit(0)).alias("votes"), F.round(value, 6).alias("alpha"))
