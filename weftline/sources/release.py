"""Sinks: the verified Parquet release, JSON lines, and flat token stores."""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from weftline.operators.sampling import running_sum

RELEASE = "id string, text string, url string, domain string, source string, snapshot string, fetched string, lid_score double, quality_score double, robots string"
RELEASE_COLUMNS = [c.split()[0] for c in RELEASE.split(", ")]


def conformed(docs: DataFrame) -> DataFrame:
    """The release's ten columns in order, missing ones null."""
    kinds = dict(c.split() for c in RELEASE.split(", "))
    return docs.select("lang", *((F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in RELEASE_COLUMNS))


def write_release(docs: DataFrame, path: str, rows_per_file: int = 50_000, row_group_bytes: int = 16 << 20) -> str:
    """Write ``docs`` by language, sorted by id, in files of at most ``rows_per_file``; refuses to overwrite. Returns the path."""
    ordered = conformed(docs).repartitionByRange("lang", "id").sortWithinPartitions("lang", "id")
    ordered.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").option("parquet.block.size", row_group_bytes).partitionBy("lang").parquet(f"{path}/data")
    return path


def manifest(spark: SparkSession, path: str) -> dict:
    """Documents and characters by language and the sha256 of every file, from what was written; also saved beside the data."""
    sums = spark.read.parquet(f"{path}/data").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select("path", F.sha2("content", 256).alias("sha256"))
    out = {"languages": {r["lang"] or "": {"docs": r["docs"], "chars": r["chars"]} for r in sums.collect()}, "files": {r["path"].split("/data/")[-1]: r["sha256"] for r in files.collect()}}
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "manifest string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return out


def verified(spark: SparkSession, path: str) -> bool:
    """The data has the manifest's rows and files, and no id twice."""
    said = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    data = spark.read.parquet(f"{path}/data")
    counts = {r["lang"] or "": r["n"] for r in data.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    files = {r["path"].split("/data/")[-1]: r["h"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data").select("path", F.sha2("content", 256).alias("h")).collect()}
    twice = data.groupBy("id").count().where("count > 1").isEmpty()
    return twice and files == said["files"] and counts == {k: v["docs"] for k, v in said["languages"].items()}


class FilesSink(DataSource):
    """``df.write.format("files").option("path", folder)`` of rows (name, data): a file each, written aside and renamed.

    Files that exist are kept as they are (a rerun goes on where it ended) unless the mode is overwrite. The folder
    must be one that all executors reach.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"], overwrite)


class _FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://"), overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        for r in rows:
            target = os.path.join(self.path, os.path.basename(r["name"]))
            if self.overwrite or not os.path.exists(target):
                aside = f"{target}.{uuid.uuid4().hex}.part"
                with open(aside, "wb") as f:
                    f.write(bytes(r["data"]))
                os.replace(aside, target)
        return WriterCommitMessage()


def shard_files(docs: DataFrame, shard: str, order: str, ending: str = ".jsonl.zst") -> DataFrame:
    """(name, data): each shard's rows as compressed JSON lines in order, without the shard column. A shard is held by one task; its size is the caller's choice."""
    rest = [c for c in docs.columns if c != shard]
    lines = docs.select(F.col(shard).cast("string").alias("shard"), F.col(order).alias("o"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("line"))

    def pack(rows: pa.Table) -> pa.Table:
        import zstandard

        data = ("\n".join(rows.sort_by("o").column("line").to_pylist()) + "\n").encode()
        data = zstandard.ZstdCompressor().compress(data) if ending.endswith(".zst") else gzip.compress(data) if ending.endswith(".gz") else data
        return pa.table({"name": [rows.column("shard")[0].as_py() + ending], "data": pa.array([data], pa.binary())})

    return lines.groupBy("shard").applyInArrow(pack, "name string, data binary")


def write_shards(docs: DataFrame, path: str, shard: str, order: str, ending: str = ".jsonl.zst") -> None:
    """``shard_files`` to a folder; files that are there already are left."""
    docs.sparkSession.dataSource.register(FilesSink)
    shard_files(docs, shard, order, ending).write.format("files").option("path", path).mode("append").save()


def fixed_parts(docs: DataFrame, parts: int, key: str) -> DataFrame:
    """``docs`` with ``part``, one of ``parts``, by hash of the key, and ``line_no``, dense in its part by the key."""
    parted = docs.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    return running_sum(parted.withColumn("_one", F.lit(1)), ["part"], [F.col(key)], "_one", "line_no").withColumn("line_no", (F.col("line_no") - 1).cast("int")).drop("_one")


def write_json_lines(docs: DataFrame, path: str, by: list[str]) -> None:
    """Gzipped JSON lines in a folder for each value of ``by``."""
    docs.write.mode("errorifexists").partitionBy(*by).option("compression", "gzip").json(path)


def _stores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's token lists as one run of 16-bit numbers, with each document's place in it."""
    ids, ends, parts, at = [], [], [], 0
    for b in batches:
        for i, tokens in zip(b.column("id").to_pylist(), b.column("tokens").to_pylist()):
            parts.append(np.array(tokens, "<u2"))
            at += len(tokens)
            ids.append(i)
            ends.append(at)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.string())), pa.array([ends], pa.list_(pa.int64()))], ["store", "ids", "ends"])


def token_store(tokens: DataFrame, seed: int = 0, parts: int = 64) -> DataFrame:
    """(store, ids, ends): flat token runs of documents (id, tokens) in a repeatable random order, ``parts`` of them."""
    mixed = tokens.withColumn("o", F.md5(F.concat_ws(":", F.lit(str(seed)), "id"))).repartition(parts, "o").sortWithinPartitions("o", "id").select("id", "tokens")
    return mixed.mapInArrow(_stores, "store binary, ids array<string>, ends array<long>")
