"""Decontamination against held-out text by shared word 13-grams, and hold-out by identity.

Grams are compared by 64-bit hashes (of 10^13 corpus grams and 10^6 held-out ones about one in two chances of a single
false hit). The corpus' grams are filtered where they are made, without a shuffle, if the held-out ones number at most
``most_sent``; beyond that both sides are shuffled, as 8-byte hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import nfc, tokens, wiki_title
from weftline.functions.urls import site


def grams(texts: DataFrame, id_col: str, text: str, n: int = 13) -> DataFrame:
    """(id, gram) of each text's different grams, as hashes of their words' hashes; a text of fewer than ``n`` words has none."""
    words = F.transform(tokens(nfc(F.coalesce(F.col(text), F.lit("")))), lambda t: F.xxhash64(t))
    hashed = F.transform(F.sequence(F.lit(1), F.size("_t") - (n - 1)), lambda i: F.xxhash64(F.slice("_t", i, n)))
    return texts.select(id_col, words.alias("_t")).where(F.size("_t") >= n).select(id_col, F.explode(F.array_distinct(hashed)).alias("gram"))


def _met(docs: DataFrame, keys: DataFrame, how: str, id_col: str, text: str, most_sent: int) -> DataFrame:
    """Documents' grams that are among ``keys``; these are sent to the workers if their number, which is counted, allows."""
    small = keys.limit(most_sent + 1).count() <= most_sent
    return grams(docs, id_col, text).join(F.broadcast(keys) if small else keys, "gram", how)


def contaminated(docs: DataFrame, held: DataFrame, id_col: str = "doc_id", text: str = "text", held_text: str = "text", most_sent: int = 1_000_000) -> DataFrame:
    """Ids of documents that share a 13-gram with a held-out text."""
    keys = grams(held.select(F.lit(0).alias("h"), F.col(held_text).alias("t")), "h", "t").select("gram").distinct()
    return _met(docs, keys, "left_semi", id_col, text, most_sent).select(id_col).distinct()


def contamination_by_set(docs: DataFrame, held: DataFrame, id_col: str = "doc_id", text: str = "text", set_col: str = "set_name", held_text: str = "text", most_sent: int = 1_000_000) -> DataFrame:
    """(id, set) for every held-out set that a document shares a 13-gram with."""
    keys = grams(held.select(F.col(set_col).alias("h"), F.col(held_text).alias("t")), "h", "t").select(F.col("h").alias(set_col), "gram").distinct()
    return _met(docs, keys, "inner", id_col, text, most_sent).select(id_col, set_col).distinct()


def identity_held(docs: DataFrame, held: DataFrame, id_col: str, url: str = "url", title_host: str = "wikipedia.org") -> DataFrame:
    """Ids held out by identity: of ``held`` (id, title), by id, or by page title on the title host's sites."""
    by_id = docs.join(held.select(F.col("id").alias(id_col)), id_col, "left_semi").select(id_col)
    named = docs.where(site(F.col(url)).endswith(title_host)).select(id_col, wiki_title(F.col(url)).alias("title"))
    by_title = named.join(held.select("title").where("title is not null").distinct(), "title", "left_semi").select(id_col)
    return by_id.union(by_title).distinct()
