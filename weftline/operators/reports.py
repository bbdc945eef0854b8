"""Aggregations and comparisons that the reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import seeded_order, strip
from weftline.operators.sampling import running_sum


def with_total(rows: DataFrame, by: str, total: str = "all") -> DataFrame:
    """Every row under its own group and under ``total``: one pass instead of two."""
    return rows.withColumn(by, F.explode(F.array(F.coalesce(by, F.lit("")), F.lit(total))))


def rule_counts(reasoned: DataFrame) -> DataFrame:
    """(lang, rule, n): rows by language and first rule (``kept`` for none), with the languages' total."""
    rule = F.coalesce(F.split_part("reason", F.lit(":"), F.lit(1)), F.lit("kept"))
    return with_total(reasoned.select("lang", rule.alias("rule")), "lang").groupBy("lang", "rule").agg(F.count("*").alias("n"))


def top_share(rows: DataFrame, group: str, item: str, size: str, k: int) -> DataFrame:
    """The ``k`` largest items of each group with their share of its tokens; ties go by name."""
    sums = rows.groupBy(group, item).agg(F.sum(size).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("tokens"), item))
    return sums.withColumn("share", F.round(F.col("tokens") / total, 6)).withColumn("rank", rank).where(F.col("rank") <= k)


def capped_alternative(rows: DataFrame, share: float, host: str, size: str, score: str, id_col: str) -> DataFrame:
    """For each host over ``share`` of all tokens: what would stay if only its best-scored documents did, up to the cap.

    Documents are taken by falling score until the first that doesn't fit; (host, docs, kept_docs, tokens, kept_tokens).
    """
    sums = rows.groupBy(host).agg(F.sum(size).alias("tokens"), F.count("*").alias("docs"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over hosts, not rows
    big = sums.withColumn("total", total).where(F.col("tokens") > share * F.col("total"))
    own = running_sum(rows.select(host, size, score, id_col).join(big.select(host, "total", F.col("tokens").alias("all_tokens")), host), [host], [F.desc(score), F.col(id_col)], size)
    kept = own.where(F.col("running") <= share / (1 - share) * (F.col("total") - F.col("all_tokens")))
    sums_kept = kept.groupBy(host).agg(F.count("*").alias("kept_docs"), F.sum(size).alias("kept_tokens"))
    return big.join(sums_kept, host, "left").select(host, "docs", F.coalesce("kept_docs", F.lit(0)).alias("kept_docs"), "tokens", F.coalesce("kept_tokens", F.lit(0)).alias("kept_tokens"))


def compare_versions(curves: DataFrame) -> DataFrame:
    """(a, b, wins, losses, unclear) of versions over held-out sets: a wins a set if all its seeds lie below all of b's."""
    each = seed_ranges(curves)
    pairs = each.alias("x").join(each.alias("y"), "held_set").where("x.version < y.version")
    win, loss = F.col("x.high") < F.col("y.low"), F.col("x.low") > F.col("y.high")
    return pairs.groupBy(F.col("x.version").alias("a"), F.col("y.version").alias("b")).agg(
        F.sum(win.cast("long")).alias("wins"), F.sum(loss.cast("long")).alias("losses"), F.sum((~win & ~loss).cast("long")).alias("unclear")
    )


def rule_report(judged: DataFrame) -> DataFrame:
    """(lang, reason, n, share, hosts, keep_rate, above_base) of documents (lang, reason, host, keep), with the total ``all``; no reason is ``survivors``."""
    rows = with_total(judged.select("lang", F.coalesce("reason", F.lit("survivors")).alias("reason"), "host", "keep"), "lang")
    groups = rows.groupBy("lang", "reason").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.avg("keep").alias("rate"))
    base = rows.groupBy("lang").agg(F.count("*").alias("all_n"), F.avg("keep").alias("base"))
    share, rate = F.round(F.col("n") / F.col("all_n"), 6), F.round("rate", 6)
    return groups.join(base, "lang").select("lang", "reason", "n", share.alias("share"), "hosts", rate.alias("keep_rate"), (F.col("rate") > F.col("base")).alias("above_base"))


def bible_site(site: Column) -> Column:
    named = site.contains("bible") | site.contains("biblica") | site.contains("beblia")
    return (site == "jw.org") | site.endswith(".jw.org") | named


def profile(rows: DataFrame, group: str, site: str, size: str, top: int = 10) -> DataFrame:
    """(group, tokens, bible_share, wiki_share, top_share), with the total ``all``: token shares of Bible sites, wikis and the ``top`` largest sites."""
    sums = with_total(rows, group).groupBy(group, site).agg(F.sum(size).alias("_n"))
    ranked = sums.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"), site)))  # over sites, not rows
    share = lambda c, name: F.round(F.sum(F.when(c, F.col("_n")).otherwise(0)) / F.sum("_n"), 6).alias(name)
    return ranked.groupBy(group).agg(F.sum("_n").alias("tokens"), share(bible_site(F.col(site)), "bible_share"), share(F.col(site).endswith("wikipedia.org"), "wiki_share"), share(F.col("_r") <= top, "top_share"))


def dropped_by(all_docs: DataFrame, dropped: DataFrame, id_col: str, by: str) -> DataFrame:
    """(by, docs, dropped): how many documents of each host or language a drop list takes."""
    marked = all_docs.select(id_col, by).join(dropped.select(id_col).distinct().withColumn("_gone", F.lit(1)), id_col, "left")
    return marked.groupBy(by).agg(F.count("*").alias("docs"), F.count("_gone").alias("dropped"))


def held_out_texts(held: DataFrame, most: int = 500, least_chars: int = 40, seed: int = 0) -> DataFrame:
    """(set_name, lang, text) of rows (item_id, set_name, lang, text, headline, choices), texts of more than ``least_chars`` characters.

    flores: different passages; news: headline and text, the first ``most``; wiki: a seeded sample of ``most``; exam:
    question and choices. Held-out sets are small; ranks run by set and language.
    """
    kind = F.col("set_name")
    text = F.when(kind == "news", F.concat_ws("\n", "headline", "text")).when(kind == "exam", F.concat_ws("\n", "text", F.array_join("choices", " "))).otherwise(F.col("text"))
    rows = held.select("item_id", kind, "lang", strip(text).alias("text")).where(F.length("text") > least_chars)
    once = rows.groupBy("set_name", "lang", F.when(kind == "flores", F.col("text")).otherwise(F.col("item_id").cast("string")).alias("_key")).agg(F.min(F.struct("item_id", "text")).alias("r"))
    order = F.when(kind == "wiki", seeded_order(seed, F.col("r.item_id"))).otherwise(F.lpad(F.col("r.item_id").cast("string"), 20, "0"))
    rank = F.row_number().over(Window.partitionBy("set_name", "lang").orderBy(order))
    return once.withColumn("_n", rank).where(kind.isin("flores", "exam") | (F.col("_n") <= most)).select("set_name", "lang", "r.text")


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    return F.round(nats / n_bytes / F.log(F.lit(2.0)), 4)


def scored_bytes(pieces: Column, text: Column, context: int) -> Column:
    """Bytes of a text's pieces from the second to the ``context``-th, those a loss is taken on; pieces that don't make up the text are an error."""
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.octet_length(x))
    whole = size(pieces) == F.octet_length(text)
    return F.when(whole, size(F.slice(pieces, 2, context - 1))).otherwise(F.raise_error(F.lit("pieces don't add up to the text")).cast("int"))


def checkpoints(steps: int, most: int = 38) -> list[int]:
    """Steps at which a run is measured: the start, then ever a square root of 2 further on from 2 (at most ``most`` times), and the end."""
    out, power = [0], 2
    while len(out) <= most and (at := round(2 ** (power / 2))) < steps:
        out.append(at)
        power += 1
    return out if steps == 0 else [*out, steps]


def seed_ranges(curves: DataFrame) -> DataFrame:
    """(version, held_set, mean, low, high) over seeds; the mean is the decimal numbers', so a half goes up in whatever order rows come."""
    exact = F.avg(F.when(F.abs("bpb") < 1e15, F.col("bpb")).cast("decimal(38,18)"))
    mean = F.when(F.bool_and(F.abs("bpb") < 1e15), F.round(exact, 4).cast("double")).otherwise(F.round(F.avg("bpb"), 4))  # NaN and what no decimal holds
    return curves.groupBy("version", "held_set").agg(mean.alias("mean"), F.min("bpb").alias("low"), F.max("bpb").alias("high"))
