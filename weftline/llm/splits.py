"""Splits that keep related records together (problem 2): an incremental table of components, and their splits.

Records sharing a host, or hosts sharing a document, belong to one component. Components are found by hooking
every node to its smallest neighbour and pointer jumping until all pointers reach a root, on edges that are
contracted after each round; earlier batches come in as their persisted component table, so only the new records'
edges are followed. An existing component keeps its split, new ones fill the splits' deficits, and a merge of
components with different splits is quarantined (split ``quarantine``), since either choice would leak.

New components fill the splits' deficits: those with at least 1/``large`` of all rows (at most ``large`` of them) go,
largest first, to the split with the greatest deficit; the others stand in a seeded order, whose running sum of rows
is laid along what is still missing in each split, so that every split is met to within one small component.

Scale: edges are stars (document to its smallest host), never pairs; every join has one row a key on one side, and
AQE splits a hot node's other side. Rounds are logarithmic in the longest chain; each is written to the shared folder.
Nulls: a null or blank doc_id joins nothing; a host that is null or a placeholder is replaced by the url's; a record
without a host is kept with its document alone, one without both gets a split by hash of its row but the text
(``row:`` nodes). Duplicate rows change weights only. Empty tables give an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.urls import host_label, host_name
from weftline.operators.components import components, star_edges
from weftline.operators.sampling import running_sum
from weftline.session import cut, shared_dir

COMPONENTS = "node string, component string, split string, status string, rows long"
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"


def record_nodes(records: DataFrame, doc_col: str = "doc_id", host_col: str = "host", url_col: str = "url") -> DataFrame:
    """(node, doc): ``host:<host>``, or ``doc:<doc_id>`` or ``row:<hash>`` of a record without a host."""
    host = F.coalesce(host_label(F.col(host_col)), host_name(F.col(url_col)))
    doc = F.when(F.trim(F.col(doc_col).cast("string")) != "", F.col(doc_col).cast("string"))
    row = F.sha2(F.to_json(F.struct(*(records[c] for c in records.columns if c != "text"))), 256)  # the texts aren't read
    node = F.when(host.isNotNull(), F.concat(F.lit("host:"), host)).when(doc.isNotNull(), F.concat(F.lit("doc:"), doc)).otherwise(F.concat(F.lit("row:"), row))
    return records.select(node.alias("node"), doc.alias("doc"))


def _chosen(u: Column, shares: dict[str, float]) -> Column:
    """The split in whose interval ``u`` lies; shares that sum to nothing fall back to the target's order."""
    total, below, out = sum(shares.values()), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        below += shares[name] / total
        out = F.when(u < below, name) if out is None else out.when(u < below, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def assign_splits(records: DataFrame, prior: DataFrame | None = None, shares: dict[str, float] | None = None, seed: int = 17, large: int = 1000, **cols: str) -> DataFrame:
    """The component table after ``records``: see COMPONENTS; status is kept, new, grown, merged or conflict.

    ``prior``: the table that an earlier call gave; its nodes stay, with their splits unless they are quarantined.
    """
    shares = shares or SHARES
    nodes = cut(record_nodes(records, **cols), "nodes")
    if prior is None:
        prior = records.sparkSession.createDataFrame([], COMPONENTS)
    docs = nodes.where("doc is not null").distinct()
    # in the table each document stands under one of its nodes, so that a later batch with other hosts finds it
    holders = docs.select(F.concat(F.lit("of:"), "doc").alias("marker"), "node").groupBy("marker").agg(F.min("node").alias("node"))
    of = prior.select("node", F.col("component").alias("old"))
    met = holders.join(of.withColumnRenamed("node", "marker"), "marker").select(F.col("old").alias("a"), F.col("node").alias("b"))
    edges = star_edges(docs, ["doc"], "node").union(met)
    for end in ("a", "b"):  # only components are merged, never the nodes they already hold
        edges = edges.join(of.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("old", end)).select("a", "b")
    joined = components(edges)
    weights = nodes.groupBy("node").agg(F.count("*").alias("added"))
    known = weights.join(prior.withColumnRenamed("component", "old"), "node", "full_outer").select(
        "node", F.coalesce("old", "node").alias("base"), "old", F.col("split").alias("old_split"),
        (F.coalesce("rows", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("rows"), F.coalesce("added", F.lit(0)).alias("added"),
    )
    fresh = holders.join(prior.select(F.col("node").alias("marker")), "marker", "left_anti").join(of, "node", "left")
    none = F.lit(None).cast("string")
    markers = fresh.select(F.col("marker").alias("node"), F.coalesce("old", "node").alias("base"), none.alias("old"), none.alias("old_split"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("added"))
    roots = joined.withColumnRenamed("node", "base")
    members = cut(known.unionByName(markers).join(roots, "base", "left").withColumn("component", F.coalesce("component", "base")), "members")
    groups = cut(
        members.groupBy("component").agg(
            F.sum("rows").alias("size"), F.sum("added").alias("added"), F.min("old_split").alias("one"), F.max("old_split").alias("other"),
            F.min("old").alias("old_a"), F.max("old").alias("old_b"), F.max(F.col("old").isNull() & ~F.col("node").startswith("of:")).alias("fresh"),
        ), "groups",
    )
    new = groups.where("one is null")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    have = {r["one"]: r["n"] for r in groups.where("one is not null and one = other").groupBy("one").agg(F.sum("size").alias("n")).collect()}
    lacking = {s: share / sum(shares.values()) * total - have.get(s, 0) for s, share in shares.items()}
    big = new.where(F.col("size") * large >= total).orderBy(F.desc("size"), "component").select("component", "size").collect()  # at most ``large`` rows
    placed = []
    for r in big:
        name = max(lacking, key=lambda s: lacking[s])
        lacking[name] -= r["size"]
        placed.append((r["component"], name))
    missing = {s: max(x, 0.0) for s, x in lacking.items()}
    at = records.sparkSession.createDataFrame(placed, "component string, given string")
    small = new.where(F.col("size") * large < total).select("component", "size", F.xxhash64(F.lit(seed), "component").alias("order"), F.lit(0).alias("all"))
    ordered = cut(running_sum(small, ["all"], [F.col("order"), F.col("component")], "size", "upto"), "fill")
    length = ordered.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    filled = ordered.select("component", _chosen((F.col("upto") - F.col("size") / 2) / max(length, 1), missing if sum(missing.values()) > 0 else shares).alias("filled"))
    split = F.when(F.col("one") != F.col("other"), QUARANTINE).when(F.col("one").isNotNull(), F.col("one")).otherwise(F.coalesce("given", "filled"))
    status = F.when(F.col("one") != F.col("other"), "conflict").when(F.col("one").isNull(), "new").when(F.col("old_a") != F.col("old_b"), "merged").when(F.col("fresh"), "grown").otherwise("kept")
    decided = groups.join(at, "component", "left").join(filled, "component", "left").select("component", split.alias("split"), status.alias("status"))
    return members.select("node", "component", "rows").join(decided, "component").select("node", "component", "split", "status", "rows")


def persist(table: DataFrame, path: str | None = None) -> str:
    """Write a component table as a new version and return its path, to be read as the next call's ``prior``."""
    path = path or f"{shared_dir(table.sparkSession)}/components-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path


def record_splits(records: DataFrame, table: DataFrame, **cols: str) -> DataFrame:
    """(node, doc, split) of each record, by its node."""
    return record_nodes(records, **cols).join(table.select("node", "component", "split"), "node")


def split_shares(table: DataFrame) -> DataFrame:
    """(split, components, rows, share)."""
    sums = table.groupBy("split").agg(F.count_distinct("component").alias("components"), F.sum("rows").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))  # over one row a split
    return sums.select("split", "components", "rows", F.round(F.col("rows") / total, 6).alias("share"))


def host_groups(table: DataFrame) -> DataFrame:
    """(host, first) of hosts that share a component with others: the component by its first host. One row a host."""
    hosts = table.where(F.col("node").startswith("host:")).select("component", F.substring("node", 6, 4000).alias("host"))
    first = hosts.groupBy("component").agg(F.min("host").alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    return hosts.join(first, "component").select("host", "first")


def linked_hosts(table: DataFrame) -> DataFrame:
    """Pairs (host_a, host_b) of hosts in one component, host_a < host_b: as many as the result has; ``host_groups`` says the same in a row a host."""
    hosts = table.where(F.col("node").startswith("host:")).select("component", F.substring("node", 6, 4000).alias("host"))
    several = hosts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    some = hosts.join(several, "component")
    return some.select("component", F.col("host").alias("host_a")).join(some.select("component", F.col("host").alias("host_b")), "component").where("host_a < host_b").select("host_a", "host_b")
