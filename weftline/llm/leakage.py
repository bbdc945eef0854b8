"""Evaluation texts leaking into training text (problem 8): spaced-seed hashing and verified overlaps.

Words are folded (no case, punctuation, diacritics or hooks; a sign alone is no word). Windows of 13 words, or of
a whole item that has fewer, are hashed under three fixed masks; each ignores every third inner position, so a
substituted word is ignored by one of them. Hashes that a document shares with an item are hits; around each hit
the two word sequences are compared along their diagonal: the longest run of equal words, and the longest overlap
without two substituted words in a row.

Scale: the index of the held-out windows is sent to the workers if it has at most ``most_indexed`` hashes, and
the corpus is then read once without a shuffle. For a larger one 2^SHARED_BITS bits of its hashes are sent, and the
documents' windows that pass them are joined by hash and reduced to distinct (document, item, diagonal); both ways give the same rows. A passage in a third of all documents is no
hot key in the first way, and one index row joined to many in the second, which AQE splits.
Nulls: null or wordless texts and items have no windows. Repeated rows come out once. Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.vec import Flat, Words, arrow_schema, chunks, list_array, splitmix
from weftline.session import cut

SPAN = 13
FOUND = "doc_id {id}, item_id {item}, exact_run int, overlap int, item_words int"
BLOOM_BITS = 22
SHARED_BITS = 26


def mask(span: int, seed: int) -> np.ndarray:
    """Positions that count: both ends, and the inner ones but every third from ``seed``."""
    return np.array([i for i in range(span) if i in (0, span - 1) or i % 3 != seed])


def _coefficients(span: int, seed: int) -> np.ndarray:
    return splitmix(np.arange(span) + (span * 8 + seed + (1 << 46)) * 64) | np.uint64(1)


def seeds(words: np.ndarray, span: int, seed: int) -> np.ndarray:
    """Hashes of all windows of ``span`` words under a mask."""
    m = len(words) - span + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(m, np.uint64), _coefficients(span, seed)
    with np.errstate(over="ignore"):
        for i in mask(span, seed):
            out += words[i : i + m] * factor[i]
    return splitmix(out)


class Index:
    """Held-out items: ``hashes`` sorted, with the item and place of each; ``bloom``: bits of the hashes."""

    def __init__(self, ids: list, words: list[np.ndarray], span: int = SPAN):
        self.ids, self.words = ids, words
        self.spans = sorted({min(span, len(w)) for w in words if len(w)})
        rows = [(h, np.full(len(h), i), np.arange(len(h))) for i, w in enumerate(words) if len(w) for s in range(3) for h in [seeds(w, min(span, len(w)), s)]]
        hashes, item, place = (np.concatenate(x) if rows else np.zeros(0, np.uint64) for x in (zip(*rows) if rows else ((), (), ())))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.bloom = np.zeros(1 << BLOOM_BITS, bool)
        self.bloom[(self.hashes >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct rows (document, item, place in the words minus place in the item)."""
        found = []
        for span in self.spans:
            if len(words) < span:
                continue
            whole = doc[: len(doc) - span + 1] == doc[span - 1 :]
            for s in range(3):
                h = seeds(words, span, s)
                at = np.flatnonzero(self.bloom[(h >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)] & whole)
                low, high = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
                n = high - low
                k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                where = np.repeat(at, n)
                found.append(np.stack([doc[where], self.item[k], where - self.place[k]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def compare(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(longest run of equal words, longest overlap without two different words in a row), with item word 0 at ``shift``."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    same = doc[a:b] == item[a - shift : b - shift]
    if not same.any():
        return 0, 0
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    far = np.r_[True, start[1:] - stop[:-1] > 1]
    first = start[far]
    last = stop[np.r_[far[1:], True]]
    return int((stop - start).max()), int((last - first).max())


def _verified(words: np.ndarray, offsets: np.ndarray, hits: np.ndarray, items: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int]]:
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for d, i, shift in hits.tolist():
        run, overlap = compare(words[offsets[d] : offsets[d + 1]], items[i], shift - int(offsets[d]))
        old = best.get((d, i), (0, 0))
        best[d, i] = max(old[0], run), max(old[1], overlap)
    return best


def _scan(batches: Iterator[pa.RecordBatch], index: Index, id_type: pa.DataType, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        texts = b.column("text").to_pylist()
        out: list[tuple] = []
        for start, stop in chunks(texts):
            w = Words(Flat(texts[start:stop]))
            best = _verified(w.hash, w.offsets, index.hits(w.hash, w.doc()), index.words)
            out += [(ids[start + d], index.ids[i], run, overlap, len(index.words[i])) for (d, i), (run, overlap) in best.items()]
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, item_type, pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "exact_run", "overlap", "item_words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, span, places, hashes) of each item: its windows under all masks."""
    for b in batches:
        texts = b.column("text").to_pylist()
        for start, stop in chunks(texts):
            w = Words(Flat(texts[start:stop]))
            lists = [w.hash[a:z] for a, z in zip(w.offsets[:-1], w.offsets[1:])]
            span = [min(SPAN, len(x)) for x in lists]
            own = [np.concatenate([seeds(x, n, s) for s in range(3)]) if n else np.zeros(0, np.uint64) for x, n in zip(lists, span)]
            place = [np.tile(np.arange(len(x) // 3, dtype=np.int32), 3) for x in own]
            counts = np.array([len(x) for x in own], np.int64)
            both = [list_array(pa.array(np.concatenate(x)), counts) for x in (place, [x.view(np.int64) for x in own])]
            yield pa.RecordBatch.from_arrays([b.column("item_id").slice(start, stop - start), list_array(pa.array(w.hash.view(np.int64)), np.diff(w.offsets)), pa.array(span, pa.int32()), *both], ["item_id", "words", "span", "places", "hashes"])


def _document_seeds(batches: Iterator[pa.RecordBatch], spans: list[int], bloom: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, words, places, hashes) of documents that have windows whose bit of the items' hashes is set: those windows."""
    for b in batches:
        texts = b.column("text").to_pylist()
        for start, stop in chunks(texts):
            w = Words(Flat(texts[start:stop]))
            doc, places, hashes = w.doc(), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for span in spans:
                if w.n < span:
                    continue
                whole = doc[: w.n - span + 1] == doc[span - 1 :]
                for s in range(3):
                    h = seeds(w.hash, span, s)
                    bit = (h >> np.uint64(64 - SHARED_BITS)).astype(np.int64)
                    at = np.flatnonzero(whole & ((bloom[bit >> 3] >> (bit & 7)) & 1).astype(bool))
                    places.append(at)
                    hashes.append(h[at])
            place, h = np.concatenate(places), np.concatenate(hashes)
            order = np.argsort(place, kind="stable")
            place, h = place[order], h[order]
            counts = np.bincount(doc[place], minlength=stop - start) if len(place) else np.zeros(stop - start, np.int64)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            sizes = np.diff(w.offsets)
            kept = np.isin(doc, some)
            inner = (place - w.offsets[doc[place]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(start, stop - start).take(pa.array(some)), list_array(pa.array(w.hash[kept].view(np.int64)), sizes[some]), list_array(pa.array(inner), counts[some]), list_array(pa.array(h.view(np.int64)), counts[some])],
                ["doc_id", "words", "places", "hashes"],
            )


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, item, shift = (b.column(n) for n in ("doc_words", "item_words", "shift"))
        pairs = [compare(d.values.to_numpy(), i.values.to_numpy(), s.as_py()) for d, i, s in zip(doc, item, shift)]
        runs, overlaps = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), pa.array(runs, pa.int32()), pa.array(overlaps, pa.int32()), item.value_lengths()], ["doc_id", "item_id", "exact_run", "overlap", "item_words"])


def _bloom(hashes: DataFrame) -> np.ndarray:
    """2^SHARED_BITS bits, those of the column ``hash`` set: or-ed in the engine, 8 MB whatever their number."""
    place = F.shiftrightunsigned("hash", 64 - SHARED_BITS) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << SHARED_BITS) // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _joined(docs: DataFrame, held: DataFrame, id_type: str, item_type: str) -> DataFrame:
    """The way for an index of any size: the documents' windows that pass the items' bits are shuffled by hash."""
    items = cut(held.mapInArrow(_item_seeds, f"item_id {item_type}, words array<long>, span int, places array<int>, hashes array<long>"), "items")
    spans = sorted(r[0] for r in items.select("span").where("span > 0").distinct().collect())  # at most 13 rows
    theirs = items.select("item_id", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("item_id", F.col("x.places").alias("item_place"), F.col("x.hashes").alias("hash"))
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(theirs))
    ours = cut(docs.mapInArrow(lambda it: _document_seeds(it, spans, sent.value), f"doc_id {id_type}, words array<long>, places array<int>, hashes array<long>").withColumn("row", F.monotonically_increasing_id()), "seeds")
    windows = ours.select("row", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("row", F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"))
    hits = windows.join(theirs, "hash").select("row", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    full = hits.join(ours.select("row", "doc_id", F.col("words").alias("doc_words")), "row").join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
    return full.select("doc_id", "item_id", "shift", "doc_words", "item_words").mapInArrow(_check, FOUND.format(id=id_type, item=item_type))


def leaked_passages(documents: DataFrame, held_out: DataFrame, most_indexed: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, exact_run, overlap, item_words) of documents and items that share a seed, verified."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = held_out.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").dropDuplicates()
    id_type, item_type = (df.schema[0].dataType.simpleString() for df in (docs, held))
    schema = FOUND.format(id=id_type, item=item_type)
    chars = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars * 3 // 2 > most_indexed:  # a word and its separator have two characters or more, a window three hashes
        found = _joined(docs, held, id_type, item_type)
    else:
        rows = held.orderBy("item_id").collect()
        w = Words(Flat([r["text"] for r in rows]))
        index = Index([r["item_id"] for r in rows], [w.hash[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:])])
        sent = documents.sparkSession.sparkContext.broadcast(index)
        arrow = {f.name: f.type for f in arrow_schema(schema)}
        found = docs.mapInArrow(lambda it: _scan(it, sent.value, arrow["doc_id"], arrow["item_id"]), schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_run").alias("exact_run"), F.max("overlap").alias("overlap"), F.max("item_words").alias("item_words"))


def leaks(found: DataFrame, least: int = SPAN) -> DataFrame:
    """Those with ``least`` or more consecutive words of an item, or the whole of a shorter one."""
    return found.where(F.col("exact_run") >= F.least(F.lit(least), "item_words"))
