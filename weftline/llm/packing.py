"""Filling fixed-capacity containers with items (problem 7): bounded-space online best-fit packing of token sequences.

Each task keeps a fixed number of open bins in a bitset keyed by free space: bit f is set if some open bin has f
free places. An item goes to the open bin with the least sufficient space; if there is none, a bin is opened, and
if too many are open the fullest closes. An item longer than the capacity is cut into full containers and a rest;
no other is cut. At the end of a task its open bins are packed into one another, largest first.

Scale: one pass over the texts, no shuffle, memory bounded by the open bins; a task leaves a few part-filled
containers at most. Container ids are the task's number and a counter, the same for the same input splits.
Nulls: null and empty texts have no tokens and stand in no container. Repeated rows are packed as often as they
come. An empty table gives no containers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.bpe import TOKENIZER, tokenizer

PACKED = "seq_id long, doc_ids array<{id}>, starts array<int>, lengths array<int>, tokens array<int>, n_tokens int, padding int"


class Packer:
    """Bounded-space best-fit. Items are (key, offset, tokens); ``add`` and ``finish`` return closed bins, as lists of items."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most = capacity, most_open
        self.bits, self.bins, self.n = 0, {}, 0

    def _put(self, free: int, items: list) -> None:
        self.bins.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.n += 1

    def _take(self, free: int) -> list:
        same = self.bins[free]
        items = same.pop()
        if not same:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.n -= 1
        return items

    def _place(self, size: int, items: list) -> None:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            self._put(free - size, self._take(free) + items)
        else:
            self._put(self.capacity - size, items)

    def add(self, key: object, tokens: list[int]) -> Iterator[list]:
        at, n = 0, len(tokens)
        while n - at > self.capacity:
            yield [(key, at, tokens[at : at + self.capacity])]
            at += self.capacity
        if n - at == self.capacity:
            yield [(key, at, tokens[at:])]
        elif n > at:
            self._place(n - at, [(key, at, tokens[at:])])
            if self.n > self.most:
                yield self._take((self.bits & -self.bits).bit_length() - 1)
            elif self.bits & 1:
                yield self._take(0)

    def finish(self) -> Iterator[list]:
        rest = sorted(((self.capacity - free, items) for free, same in self.bins.items() for items in same), key=lambda x: -x[0])
        self.bits, self.bins, self.n = 0, {}, 0
        for size, items in rest:
            self._place(size, items)
        while self.n:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, most_open: int, path: str) -> Iterator[pa.RecordBatch]:
    encode, packer = tokenizer(path).encode_ordinary, Packer(capacity, most_open)
    task = TaskContext.get()
    base, count, key_type = (task.partitionId() if task else 0) << 32, 0, None

    def emit(bins: list[list]) -> pa.RecordBatch:
        nonlocal count
        sizes = [len(b) for b in bins]
        flat = [x for b in bins for x in b]
        lengths = np.array([len(x[2]) for x in flat], np.int32)
        per_bin = np.add.reduceat(lengths, np.r_[0, np.cumsum(sizes)[:-1]]).astype(np.int32) if bins else np.zeros(0, np.int32)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        ids = pa.array(np.arange(count, count + len(bins)) + base, pa.int64())
        count += len(bins)
        tokens = np.fromiter((t for x in flat for t in x[2]), np.int32, int(lengths.sum()))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array([x[0] for x in flat], key_type), pa.array([x[1] for x in flat], pa.int32()), pa.array(lengths))]
        token_lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_bin)].astype(np.int32)), pa.array(tokens))
        return pa.RecordBatch.from_arrays([ids, *lists, token_lists, pa.array(per_bin), pa.array((capacity - per_bin).astype(np.int32))], ["seq_id", "doc_ids", "starts", "lengths", "tokens", "n_tokens", "padding"])

    for b in batches:
        key_type = b.schema.field("doc_id").type
        closed: list[list] = []
        for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if text:
                closed.extend(packer.add(key, encode(text)))
                if len(closed) >= 1000:
                    yield emit(closed)
                    closed = []
        yield emit(closed)
    if key_type is not None:
        yield emit(list(packer.finish()))


def packed_sequences(documents: DataFrame, capacity: int = 1024, most_open: int = 256, tokenizer_path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Training sequences of at most ``capacity`` tokens; see PACKED. ``starts``: where in its document each piece begins."""
    documents.sparkSession.sparkContext.addFile(tokenizer_path)
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda it: _pack(it, capacity, most_open, tokenizer_path), PACKED.format(id=slim.schema[0].dataType.simpleString()))


def packing_report(packed: DataFrame) -> DataFrame:
    """(sequences, pieces, tokens, padding, padding_share)."""
    sums = packed.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("pieces"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("padding"), F.lit(0)).alias("padding"))
    return sums.withColumn("padding_share", F.round(F.coalesce(F.try_divide("padding", F.col("padding") + F.col("tokens")), F.lit(0.0)), 6))
