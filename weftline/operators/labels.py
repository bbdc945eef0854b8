"""Labels to data sets, score tables, and a keep/drop classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import nfc, tokens


def votes(labels: DataFrame) -> DataFrame:
    """One row a document: (doc_id, lang, url, host, shared, n_labels, keeps, agreement) of its labels that aren't void.

    A label keeps if it is 1. The document's own columns come from its first label by time, then annotator.
    The host keeps ``www.`` and its port.
    """
    valid = labels.where("doc_id is not null and lower(trim(coalesce(status, ''))) <> 'void' and label is not null").select(
        "doc_id", "lang", "url", "shared", "label", F.struct(F.coalesce("labelled_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("at"), F.coalesce("annotator", F.lit("")).alias("who"), "label", F.coalesce("url", F.lit("")).alias("u")).alias("order")
    )
    first = lambda c: F.min_by(c, "order").alias(c)
    grouped = valid.groupBy("doc_id").agg(first("lang"), first("url"), first("shared"), F.count("*").alias("n_labels"), F.sum((F.col("label") == 1).cast("int")).alias("keeps"))
    share = F.col("keeps") / F.col("n_labels")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return grouped.withColumn("host", host).withColumn("agreement", F.round(F.greatest(share, 1 - share), 3))


def test_set(voted: DataFrame) -> DataFrame:
    """Shared documents with two labels or more and no tie, by majority."""
    kept = voted.where("shared = 1 and n_labels >= 2 and keeps * 2 <> n_labels")
    return kept.withColumn("keep", (F.col("keeps") * 2 > F.col("n_labels")).cast("int"))


def train_set(voted: DataFrame, test: DataFrame) -> DataFrame:
    """Documents that aren't shared, on hosts without a test document; ties keep."""
    apart = voted.where("shared <> 1").join(test.select("host").distinct(), "host", "left_anti")
    return apart.withColumn("keep", (F.col("keeps") * 2 >= F.col("n_labels")).cast("int"))


def latest_scores(*tables: DataFrame) -> DataFrame:
    """(id, p): of an id's scores in several tables the last table's."""
    out = None
    for priority, t in enumerate(tables):
        one = t.select("id", "p", F.lit(priority).alias("priority"))
        out = one if out is None else out.union(one)
    return out.groupBy("id").agg(F.max_by("p", "priority").alias("p"))


def join_scores(docs: DataFrame, scores: DataFrame, id_col: str = "id", optional: str | None = None) -> DataFrame:
    """``docs`` with their ``p``. A document without one is dropped if its column ``optional`` is true, and an error else."""
    joined = docs.join(scores.select(id_col, "p"), id_col, "left")
    may_lack = F.coalesce(F.col(optional), F.lit(False)) if optional else F.lit(False)
    lacking = F.raise_error(F.concat(F.lit("no score for "), F.col(id_col).cast("string"))).cast("double")
    return joined.withColumn("p", F.when(F.col("p").isNull() & ~may_lack, lacking).otherwise(F.col("p"))).where("p is not null")


def release_rows(docs: DataFrame, shards: DataFrame, recrawl: DataFrame, folded: DataFrame) -> DataFrame:
    """``docs`` (id, url, text, source) with what their source knows of them: snapshot, lid_score, fetched.

    cc: by id among ``shards`` (id, url, text, wet_file, lid_prob), whose url and text must be the document's; recrawl:
    by id in ``recrawl`` (id, lid_prob, fetched); fw2: by the id after its prefix in ``folded`` (id, language_score).
    Every source is joined with its own documents only; texts are compared by hash.
    """
    part = lambda name: docs.where(F.col("source") == name)
    own = shards.select("id", F.xxhash64("url", "text").alias("h"), F.split_part("wet_file", F.lit("/"), F.lit(2)).alias("snapshot"), F.col("lid_prob").alias("lid_score"))
    other = F.raise_error(F.concat(F.col("id"), F.lit(" does not match its shard"))).cast("string")
    cc = part("cc").withColumn("g", F.xxhash64("url", "text")).join(own, "id", "left").withColumn("snapshot", F.when(F.col("g").eqNullSafe(F.col("h")), F.col("snapshot")).otherwise(other)).drop("g", "h").withColumn("fetched", F.lit(None).cast("string"))
    again = part("recrawl").join(recrawl.select("id", F.col("lid_prob").alias("lid_score"), F.col("fetched").cast("string").alias("fetched")), "id", "left")
    fold = part("fw2").withColumn("k", F.regexp_replace("id", "^[^:]*:", "")).join(folded.select(F.col("id").alias("k"), F.col("language_score").alias("lid_score")), "k", "left").drop("k")
    return cc.unionByName(again, allowMissingColumns=True).unionByName(fold, allowMissingColumns=True)


def metrics(scored: DataFrame, by: str = "lang", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and base rate of ``p > threshold`` against ``keep``, by language and over all (``all``)."""
    hit = (F.col("p") > threshold).cast("int")
    each = scored.select(F.explode(F.array(F.coalesce(by, F.lit("")), F.lit("all"))).alias(by), F.col("keep"), hit.alias("hit"))
    sums = each.groupBy(by).agg(
        F.count("*").alias("n"), F.sum((F.col("hit") == F.col("keep")).cast("int")).alias("right"), F.sum(F.col("hit") * F.col("keep")).alias("tp"), F.sum("hit").alias("said"), F.sum("keep").alias("base")
    )
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 4)
    return sums.select(by, "n", rate("right", "n").alias("accuracy"), rate("tp", "said").alias("precision"), rate("tp", "base").alias("recall"), rate("base", "n").alias("base"))


def keep_probability(train: DataFrame, docs: DataFrame, id_col: str = "id", text: str = "text", most_train: int = 20_000, features: int = 1 << 14) -> DataFrame:
    """(id, p) of every document by a logistic model of hashed tokens.

    ``train`` (text, keep) is used up to ``most_train`` rows, taken by the md5 of their texts; every document is scored.
    """
    bounded = train.where("text is not null").orderBy(F.md5("text")).limit(most_train)
    tok = lambda d: d.withColumn("tokens", tokens(nfc(F.coalesce(F.col("text"), F.lit("")))))
    stages = [HashingTF(inputCol="tokens", outputCol="features", numFeatures=features), LogisticRegression(labelCol="keep", maxIter=15, regParam=0.01)]
    model = Pipeline(stages=stages).fit(tok(bounded.select("text", F.col("keep").cast("double").alias("keep"))))
    scored = model.transform(tok(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))))
    return scored.select("id", F.round(vector_to_array("probability")[1], 4).alias("p"))
