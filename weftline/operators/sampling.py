"""Token budgets, site caps, quotas and repeatable samples.

Running sums are made in two levels: rows are sorted in ranges of equal size over all workers, each range has its own
running sum, and a range's start is the sum of its group's ranges before it. So no group, and no run of equal keys, is
held in one task.

The greedy rules are sequential by definition (an item is skipped if it doesn't fit what is left). They go in rounds:
a round takes all items before the first that overflows, by running sum, and only those that fit what is left go on.
Each round ends with an item larger than what is left, so what is left shrinks fast. At most ``most_walked`` remaining
candidates, of all groups together, are walked in one go instead, which gives the same items.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import seeded_order
from weftline.session import cut


def _order(seed: int, id_col: str) -> list[Column]:
    return [seeded_order(seed, F.col(id_col)), F.col(id_col)]


def running_sum(rows: DataFrame, groups: list[str], order: list[str | Column], value: str, out: str = "running") -> DataFrame:
    """``rows`` with the sum of ``value`` over their group's rows up to each, in an order without ties; nulls count 0."""
    part, base = "__range", "__base"
    filled = rows.withColumn(value, F.coalesce(value, F.lit(0)))
    ranged = cut(filled.repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*groups, part).agg(F.sum(value).alias(base))  # a row for each group and range
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(g).alias(f"__{g}") for g in groups), F.col(part).alias("__of"), F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    own = F.sum(value).over(Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    joined = ranged.withColumn(out, own).join(starts, [*same, F.col(part) == F.col("__of")])
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(part, base, "__of", *(f"__{g}" for g in groups))


def budget_prefix(docs: DataFrame, budget: int, id_col: str, size: str, groups: list[str], seed: int = 0) -> DataFrame:
    """The random order's prefix up to the first document that overflows the group's budget."""
    ordered = docs.withColumn("_order", _order(seed, id_col)[0])
    return running_sum(ordered, groups, ["_order", id_col], size).where(F.col("running") <= budget).drop("_order")


def _fill(sizes: list[int], left: int) -> list[int]:
    """Positions that a greedy pass takes."""
    out = []
    for i, n in enumerate(sizes):
        if n <= left:
            out.append(i)
            left -= n
    return out


def greedy_fill(docs: DataFrame, budgets: DataFrame, id_col: str, size: str, group: str, seed: int = 0, most_walked: int = 1_000_000) -> DataFrame:
    """Random documents of each group, greedily up to its ``budget``: a document that doesn't fit is skipped. See the module."""
    spark = docs.sparkSession
    rest = docs.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"), seeded_order(seed, F.col(id_col)).alias("o")).join(budgets.select(F.col(group).alias("g"), F.col("budget").cast("long").alias("left")), "g")
    taken: DataFrame | None = None
    while True:
        rest = cut(rest.where("n <= left"), "rest")
        count = rest.count()
        if count == 0:
            break
        if count <= most_walked:
            walked = rest.groupBy("g").applyInPandas(_walk, f"g {rest.schema['g'].dataType.simpleString()}, i {rest.schema['i'].dataType.simpleString()}")
            taken = walked if taken is None else taken.union(walked)
            break
        marked = cut(running_sum(rest, ["g"], ["o", "i"], "n", "run"), "run")
        now = marked.where("run <= left")  # sizes aren't negative, so these are a prefix
        taken = now.select("g", "i") if taken is None else taken.union(now.select("g", "i"))
        used = now.groupBy("g").agg(F.sum("n").alias("used"))
        # the document that overflowed is skipped for good: everything after it that still fits goes on
        rest = marked.where("run > left").join(used, "g", "left").select("g", "i", "n", "o", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
    if taken is None:
        return spark.createDataFrame([], docs.select(group, id_col).schema)
    return taken.select(F.col("g").alias(group), F.col("i").alias(id_col))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["o", "i"])
    picked = _fill(rows["n"].tolist(), int(rows["left"].iloc[0]))
    return rows.iloc[picked][["g", "i"]]


def _capped(rows: pd.DataFrame, share: float) -> pd.DataFrame:
    """One group's site cap, on rows (g, i, n, s, o)."""
    rows = rows.sort_values(["o", "i"])
    sites = {s: part for s, part in rows.groupby("s")}
    tokens = {s: int(part["n"].sum()) for s, part in sites.items()}
    while tokens:
        total = sum(tokens.values())
        worst = min(tokens, key=lambda s: (-tokens[s], s))
        if tokens[worst] <= share * total:
            break
        part = sites[worst]
        sites[worst] = part.iloc[_fill(part["n"].tolist(), math.floor(share / (1 - share) * (total - tokens[worst])))]
        tokens[worst] = int(sites[worst]["n"].sum())
        if not tokens[worst]:
            del sites[worst], tokens[worst]
    return pd.concat(sites.values())[["g", "i"]] if sites else rows.iloc[:0][["g", "i"]]


def site_cap(docs: DataFrame, share: float, id_col: str, size: str, group: str, site: str, seed: int = 0, most_walked: int = 1_000_000) -> DataFrame:
    """(group, id) kept so that no site has more than ``share`` of its group's tokens.

    While the largest site (of equals the first by name) exceeds the share, a greedy random subset of it that fits
    share / (1 - share) of the others' tokens is kept; every round shrinks a site, so they end. A round is one
    aggregation and a fill of the sites over the share. At most ``most_walked`` rows of all groups together are
    walked in one go for each group, with the same result.
    """
    rows = cut(docs.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(size).cast("long").alias("n"), F.coalesce(site, F.lit("")).alias("s")), "cap")
    if rows.count() <= most_walked:
        ordered = rows.withColumn("o", seeded_order(seed, F.col("i")))
        walked = ordered.groupBy("g").applyInPandas(lambda x: _capped(x, share), f"g {rows.schema['g'].dataType.simpleString()}, i {rows.schema['i'].dataType.simpleString()}")
        return walked.select(F.col("g").alias(group), F.col("i").alias(id_col))
    while True:
        sums = rows.groupBy("g", "s").agg(F.sum("n").alias("tokens"))
        total = F.sum("tokens").over(Window.partitionBy("g"))
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("tokens"), "s"))
        worst = sums.select("g", "s", "tokens", total.alias("total"), rank.alias("rank")).where("rank = 1").where(F.col("tokens") > share * F.col("total"))
        over = cut(worst.select("g", "s", F.floor(share / (1 - share) * (F.col("total") - F.col("tokens"))).alias("budget")), "over")
        if over.isEmpty():
            break
        own = rows.join(over.select("g", "s"), ["g", "s"], "left_semi")
        kept = greedy_fill(own.select(F.col("g"), F.col("i"), F.col("n")), over.select("g", "budget"), "i", "n", "g", seed, most_walked)
        others = rows.join(over.select("g", "s"), ["g", "s"], "left_anti")
        rows = cut(others.unionByName(own.join(kept, ["g", "i"], "left_semi")), "cap")
    return rows.select(F.col("g").alias(group), F.col("i").alias(id_col))


def language_quota(versions: DataFrame, version: str, group: str, size: str) -> DataFrame:
    """(group, budget): for each group the smallest version's tokens."""
    sums = versions.groupBy(version, group).agg(F.sum(size).alias("tokens"))
    return sums.groupBy(group).agg(F.min("tokens").alias("budget"))


def global_budget(versions: DataFrame, version: str, size: str, fixed: int | None = None) -> DataFrame:
    """(version, budget): every version's budget is the smallest version's tokens, or a fixed number."""
    sums = versions.groupBy(version).agg(F.sum(size).alias("tokens"))
    least = F.lit(fixed).cast("long") if fixed is not None else F.min("tokens").over(Window.partitionBy(F.lit(1)))  # over versions, not rows
    return sums.select(version, least.alias("budget"))


def length_batches(docs: DataFrame, id_col: str, size: str, batch: int = 64) -> DataFrame:
    """(batch, id, size): documents in batches of about one length, longest first; ``batch`` documents each but the last."""
    numbered = running_sum(docs.select(F.col(id_col).alias("id"), F.col(size).alias("size"), F.lit(1).alias("one"), F.lit("").alias("all")), ["all"], [F.desc("size"), F.col("id")], "one", "place")
    return numbered.select(F.floor((F.col("place") - 1) / batch).alias("batch"), "id", "size")


def epochs(chunks: DataFrame, passes: int, id_col: str, seed: int = 0) -> DataFrame:
    """(pass, id, order): every chunk once in each pass; ``order`` sorts a pass's chunks, anew for each."""
    each = chunks.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.col("id").cast("string")))
    return each.select("pass", "id", order.alias("order"))
