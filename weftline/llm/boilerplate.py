"""Lines repeated across one site's documents (problem 3): a compressed bitmap of pages for each line of each host.

The pages of a host are numbered. The pages on which a spelling of a line stands are held as containers of 65,536
numbers, each a sorted array, a bitmap or runs, whichever is smallest. Lines with the same letters are variants:
their containers are united, the cardinality of the union is exact, and lines at or above the threshold are
deleted by looking the pages' numbers up in the united containers.

Scale: texts are read once and not shuffled for the counts; a page's hashes are sent once to the part of its host and
once more, those of candidate lines only, to be looked up. A host with more than ``part`` rows is parted by the path
(there are at most rows / ``part`` such hosts, and only their sizes go to the workers), so a part's containers are
made in one pass over sorted pages with a buffer of ``MOST_LINES`` lines; a part that is larger still, as that of one
page crawled very often, gives several containers of one chunk, which are united. A host in one part keeps only lines
that reach the threshold there; no shuffle then holds a line that stands on fewer pages. Batches are bounded by the
numbers that their containers hold.
Nulls: a page without a host (null or relative url) neither counts nor loses lines; a null or empty text has one
empty line, which has no letters and doesn't count. Exact duplicate rows and re-crawls (one host and path) are
one page. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import host_name, url_path
from weftline.llm.vec import arrow_schema, chunks, line_hashes, list_array
from weftline.session import cut

CHUNK = 1 << 16
ARRAY, BITMAP, RUNS = 0, 1, 2
PART = 1 << 14  # rows of a host that are kept together
MOST_LINES = 400_000  # lines in a task's buffer
MOST_NUMBERS = 1_000_000  # numbers that are decoded at a time
KEYED = "page_id {id}, host long, salt int, salts int, path long, keys array<long>, raws array<long>"
BUILT = "tag int, host long, chunk int, line long, variant long, pages int, kind int, data binary, page_id {id}, low int, keys array<long>, places array<int>"
CONTAINERS = "host long, line long, chunk int, pages int, kind int, data binary"
OF_LINE, OF_PAGE = 0, 1


# --- containers

def encode(lows: np.ndarray) -> tuple[int, bytes]:
    """The smallest form of a sorted set of 16-bit numbers: array, bitmap or runs (start, length - 1)."""
    breaks = np.flatnonzero(np.diff(lows) != 1) + 1
    first, last = lows[np.r_[0, breaks]], lows[np.r_[breaks - 1, len(lows) - 1]]
    sizes = (2 * len(lows), CHUNK // 8, 4 * len(first))
    if sizes[RUNS] < min(sizes[:2]):
        return RUNS, np.stack([first, last - first], 1).astype("<u2").tobytes()
    if sizes[BITMAP] < sizes[ARRAY]:
        bits = np.zeros(CHUNK, np.uint8)
        bits[lows] = 1
        return BITMAP, np.packbits(bits, bitorder="little").tobytes()
    return ARRAY, lows.astype("<u2").tobytes()


def decode(kind: int, data: bytes) -> np.ndarray:
    """The sorted numbers of a container."""
    if kind == BITMAP:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    numbers = np.frombuffer(data, "<u2").astype(np.int64)
    if kind == ARRAY:
        return numbers
    first, more = numbers[::2], numbers[1::2] + 1
    return np.repeat(first - np.r_[0, np.cumsum(more)[:-1]], more) + np.arange(more.sum())


def bits_of(kind: int, data: bytes) -> np.ndarray:
    """A container as the bytes of a bitmap."""
    if kind == BITMAP:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(65536, np.uint8)
    bits[decode(kind, data)] = 1
    return np.packbits(bits, bitorder="little")


def united(containers: list[tuple[int, bytes]]) -> np.ndarray:
    """The sorted numbers of a union: short arrays are merged, all else is or-ed as bitmaps."""
    if len(containers) == 1:
        return decode(*containers[0])
    if all(k == ARRAY for k, _ in containers) and sum(len(d) for _, d in containers) <= CHUNK // 8:
        return np.unique(np.frombuffer(b"".join(d for _, d in containers), "<u2")).astype(np.int64)
    bits = np.zeros(8192, np.uint8)
    for kind, data in containers:
        bits |= bits_of(kind, data)
    return np.flatnonzero(np.unpackbits(bits, bitorder="little"))


def encoded(lows: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(kinds, data) of many sorted sets that lie one after the other in ``lows``; see ``encode``."""
    kinds, flat = np.full(len(first), ARRAY), lows.astype("<u2").tobytes()
    data = [flat[2 * a : 2 * (a + n)] for a, n in zip(first.tolist(), size.tolist())]
    step = np.r_[True, np.diff(lows) != 1]
    step[first] = True
    runs = np.add.reduceat(step, first) if len(first) else first
    for i in np.flatnonzero((2 * runs < size) | (size > CHUNK // 16)):
        kinds[i], data[i] = encode(lows[first[i] : first[i] + size[i]])
    return kinds, data


# --- pages and their lines

def _with_keys(batches: Iterator[pa.RecordBatch], large: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pages with the hashes of their lines and their part of the host; ``large``: sorted hosts and their numbers of parts."""
    hosts, parts = large
    for b in batches:
        for start, stop in chunks(b.column("text").to_pylist()):
            part = b.slice(start, stop - start)
            counts, keys, raws = line_hashes(part.column("text").to_pylist())
            host, path = part.column("host").to_numpy(), part.column("path").to_numpy()
            at = np.searchsorted(hosts, host)
            salts = np.where(np.r_[hosts, hosts[:1]][np.minimum(at, len(hosts))] == host, np.r_[parts, parts[:1]][np.minimum(at, len(hosts))], 1) if len(hosts) else np.ones(len(host), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("host"), pa.array((path % salts).astype(np.int32)), pa.array(salts.astype(np.int32)), part.column("path"), list_array(pa.array(keys.view(np.int64)), counts), list_array(pa.array(raws.view(np.int64)), counts)],
                ["page_id", "host", "salt", "salts", "path", "keys", "raws"],
            )


class _Builder:
    """Sorted pages of parts of hosts to containers of each spelling (OF_LINE) and the pages' candidate lines (OF_PAGE)."""

    def __init__(self, least: int, schema: pa.Schema, chunk: int):
        self.least, self.schema, self.chunk = least, schema, chunk
        self.host = self.salt = self.path = None
        self.rank = -1

    def build(self, rows: list[pa.RecordBatch], open_end: bool) -> Iterator[pa.RecordBatch]:
        """``open_end``: more pages of the last part may come."""
        table = pa.Table.from_batches(rows).combine_chunks()
        host, salt, salts, path = (table.column(c).to_numpy() for c in ("host", "salt", "salts", "path"))
        begins = np.r_[(host[0], salt[0]) != (self.host, self.salt), (host[1:] != host[:-1]) | (salt[1:] != salt[:-1])]
        carried = not begins[0]
        turns = begins | np.r_[path[0] != self.path, path[1:] != path[:-1]]
        nth, part = np.cumsum(turns), np.cumsum(begins) - (not carried)
        first_row = np.flatnonzero(begins)
        base = np.r_[nth[0] - int(turns[0]) - self.rank, nth[first_row]] if carried else nth[first_row]
        rank = nth - base[part]
        self.host, self.salt, self.path, self.rank = host[-1], salt[-1], path[-1], int(rank[-1])
        top = np.zeros(part[-1] + 1, np.int64)
        np.maximum.at(top, part, rank)
        whole = (salts[np.r_[0, first_row] if carried else first_row] == 1) & (top < self.chunk)
        whole[0] &= not carried
        whole[-1] &= not open_end
        chunk = salt + salts.astype(np.int64) * (rank // self.chunk)
        low = rank % self.chunk

        lists = table.column("keys").chunk(0)
        counts = np.diff(lists.offsets.to_numpy())
        key, raw = lists.flatten().to_numpy(), table.column("raws").chunk(0).flatten().to_numpy()
        row = np.repeat(np.arange(len(host)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        named = np.flatnonzero(key)
        unit = np.cumsum(np.r_[True, (part[1:] != part[:-1]) | (chunk[1:] != chunk[:-1])]) - 1  # one of a part's chunks
        u, k, w = unit[row[named]], key[named], low[row[named]]
        order = np.lexsort((w, k, u))
        u, k, w = u[order], k[order], w[order]
        line_at = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (k[1:] != k[:-1])]) if len(u) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[line_at, len(u)])
        other = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, bool)
        other[line_at] = True
        pages = np.add.reduceat(other, line_at) if len(line_at) else line_at
        kept = named[order][np.repeat((pages >= self.least) | ~whole[part[row[named][order][line_at]]], sizes)]
        if not len(kept):
            return
        yield self._lines(host, chunk, low, unit, row[kept], key[kept], raw[kept])
        kept.sort()
        yield self._pages(table, host, chunk, low, row[kept], key[kept], place[kept])

    def _batch(self, n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in self.schema], schema=self.schema)

    def _lines(self, host: np.ndarray, chunk: np.ndarray, low: np.ndarray, unit: np.ndarray, row: np.ndarray, key: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((low[row], raw, key, unit[row]))
        row, key, raw = row[order], key[order], raw[order]
        u, w = unit[row], low[row]
        line = np.r_[True, (u[1:] != u[:-1]) | (key[1:] != key[:-1]) | (raw[1:] != raw[:-1])]
        fresh = np.flatnonzero(line | np.r_[True, w[1:] != w[:-1]])
        first = np.flatnonzero(line[fresh])
        size = np.diff(np.r_[first, len(fresh)])
        kinds, data = encoded(w[fresh], first, size)
        at = fresh[first]
        return self._batch(len(at), tag=pa.array(np.full(len(at), OF_LINE)), host=pa.array(host[row[at]]), chunk=pa.array(chunk[row[at]]), line=pa.array(key[at]), variant=pa.array(raw[at]), pages=pa.array(size), kind=pa.array(kinds), data=pa.array(data, pa.binary()))

    def _pages(self, table: pa.Table, host: np.ndarray, chunk: np.ndarray, low: np.ndarray, row: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        some, counts = np.unique(row, return_counts=True)
        ids = table.column("page_id").chunk(0).take(pa.array(some))
        return self._batch(len(some), tag=pa.array(np.full(len(some), OF_PAGE)), host=pa.array(host[some]), chunk=pa.array(chunk[some]), page_id=ids, low=pa.array(low[some]), keys=list_array(pa.array(key), counts), places=list_array(pa.array(place.astype(np.int32)), counts))


def _build(batches: Iterator[pa.RecordBatch], least: int, schema: pa.Schema, chunk: int, most: int) -> Iterator[pa.RecordBatch]:
    builder, held, lines = _Builder(least, schema, chunk), [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ends = b.column("keys").offsets.to_numpy()
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(ends[0] + most, ends[-1], most)), b.num_rows])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            held.append(b.slice(a, z - a))
            lines += int(ends[z] - ends[a])
            if lines < most:
                continue
            last = held[-1]
            host, salt = last.column("host").to_numpy(), last.column("salt").to_numpy()
            inner = np.flatnonzero((host != host[-1]) | (salt != salt[-1]))
            at = int(inner[-1]) + 1 if len(inner) else 0
            # whole parts go; the last waits for its end, or goes in pieces if it fills the buffer alone
            if at:
                yield from builder.build([*held[:-1], last.slice(0, at)], False)
                held = [last.slice(at)]
            else:
                yield from builder.build(held, True)
                held = []
            lines = sum(int(x.column("keys").offsets.to_numpy()[-1] - x.column("keys").offsets.to_numpy()[0]) for x in held)
    if held:
        yield from builder.build(held, False)


def page_lines(pages: DataFrame, least: int, id_col: str = "page_id", url_col: str = "url", text_col: str = "wet_text", part: int = PART) -> DataFrame:
    """The containers of each spelling of each candidate line, and each page's candidate lines; see BUILT."""
    hashed = pages.select(F.col(id_col).alias("page_id"), host_name(F.col(url_col)).alias("h"), url_path(F.col(url_col)).alias("p"), F.col(text_col).alias("text")).where("h is not null")
    hashed = hashed.select("page_id", F.xxhash64("h").alias("host"), F.xxhash64("p").alias("path"), "text")
    sizes = hashed.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > part).orderBy("host").collect()  # at most rows / part
    large = np.array([r["host"] for r in sizes], np.int64), np.array([-(-r["n"] // part) for r in sizes], np.int64)
    id_type, chunk, most = hashed.schema["page_id"].dataType.simpleString(), CHUNK, MOST_LINES
    sent = pages.sparkSession.sparkContext.broadcast(large)
    keyed = hashed.mapInArrow(lambda it: _with_keys(it, sent.value), KEYED.format(id=id_type))
    built = BUILT.format(id=id_type)
    schema = arrow_schema(built)
    order = ["host", "salt", "path"]
    return cut(keyed.repartition("host", "salt").sortWithinPartitions(*order).mapInArrow(lambda it: _build(it, least, schema, chunk, most), built), "lines")


# --- unions, thresholds, look-ups

def _groups(*columns: np.ndarray) -> np.ndarray:
    """First rows of runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by host, line and chunk to one for each."""
    names = ["host", "line", "chunk", "pages", "kind", "data"]
    last: tuple | None = None
    for b in batches:
        host, line, chunk, sizes = (b.column(c).to_numpy() for c in names[:4])
        kinds, data = b.column("kind").to_pylist(), b.column("data").to_pylist()
        out: list[tuple] = []
        first = _groups(host, line, chunk)
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(host)]):
            key = (int(host[a]), int(line[a]), int(chunk[a]))
            own = list(zip(kinds[a:z], data[a:z]))
            if last is not None and last[:3] == key:
                own.append(last[4:])
            elif last is not None:
                out.append(last)
            if len(own) == 1:
                last = (*key, int(sizes[a]), *own[0])
            else:
                lows = united(own)
                last = (*key, len(lows), *encode(lows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names)


def line_bitmaps(built: DataFrame) -> DataFrame:
    """The united containers of each line; see CONTAINERS."""
    lines = built.where(F.col("tag") == OF_LINE).select("host", "line", "chunk", "pages", "kind", "data")
    return lines.repartition("host", "line", "chunk").sortWithinPartitions("host", "line", "chunk").mapInArrow(_unite, CONTAINERS)


def frequent_lines(bitmaps: DataFrame, least: int) -> DataFrame:
    """(host, line, total) of the lines on ``least`` pages or more; cardinalities are exact."""
    return bitmaps.groupBy("host", "line").agg(F.sum("pages").alias("total")).where(F.col("total") >= least)


class _Lookup:
    """The frequent lines of one chunk of a host: sorted lines, and (line's place << 16 | page's number) of their containers."""

    def __init__(self) -> None:
        self.key: tuple[int, int] | None = None
        self.parts: list[tuple[int, np.ndarray]] = []
        self.ready: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, key: tuple[int, int], line: np.ndarray, kinds: list[int], data: list[bytes]) -> None:
        if key != self.key:
            self.key, self.parts = key, []
        self.parts += [(int(x), decode(k, d)) for x, k, d in zip(line, kinds, data)]
        self.ready = None

    def hits(self, key: tuple[int, int], lines: np.ndarray, low: np.ndarray) -> np.ndarray:
        if key != self.key or not self.parts:
            return np.zeros(len(lines), bool)
        if self.ready is None:
            self.parts.sort(key=lambda x: x[0])
            sizes = [len(p) for _, p in self.parts]
            self.ready = np.array([x for x, _ in self.parts], np.int64), np.concatenate([p for _, p in self.parts]) + (np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 16)
        known, codes = self.ready
        at = np.minimum(np.searchsorted(known, lines), len(known) - 1)
        code = (at << 16) + low
        return (known[at] == lines) & (codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code)


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, chunk and tag to (page_id, line_no, host, line) of the lines that pages lose."""
    lookup = _Lookup()
    for b in batches:
        host, chunk, tag = (b.column(c).to_numpy() for c in ("host", "chunk", "tag"))
        out: list[tuple] = []
        first = _groups(host, chunk, tag)
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(host)]):
            key, part = (int(host[a]), int(chunk[a])), b.slice(a, z - a)
            if tag[a] == OF_LINE:
                lookup.add(key, part.column("line").to_numpy(), part.column("kind").to_pylist(), part.column("data").to_pylist())
                continue
            lists = part.column("keys")
            counts = np.diff(lists.offsets.to_numpy())
            lines, places = lists.flatten().to_numpy(), part.column("places").flatten().to_numpy()
            row = np.repeat(np.arange(z - a), counts)
            hit = np.flatnonzero(lookup.hits(key, lines, part.column("low").to_numpy().astype(np.int64)[row]))
            out.append((part.column("page_id").take(pa.array(row[hit])), places[hit], np.full(len(hit), host[a]), lines[hit]))
        ids = pa.concat_arrays([x[0] for x in out]) if out else pa.array([], b.schema.field("page_id").type)
        rest = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(rest[0].astype(np.int32)), pa.array(rest[1]), pa.array(rest[2])], ["page_id", "line_no", "host", "line"])


def _found(built: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((page_id, line_no, host, line) of the deleted lines of each row, the frequent lines)."""
    bitmaps = cut(line_bitmaps(built), "bitmaps")
    frequent = frequent_lines(bitmaps, least)
    wanted = bitmaps.join(frequent, ["host", "line"], "left_semi").select(F.lit(OF_LINE).alias("tag"), "host", "chunk", "line", "kind", "data")
    pages = built.where(F.col("tag") == OF_PAGE).select("tag", "host", "chunk", "page_id", "low", "keys", "places")
    both = wanted.unionByName(pages, allowMissingColumns=True).repartition("host", "chunk").sortWithinPartitions("host", "chunk", "tag")
    kind = built.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(_deleted, f"page_id {kind}, line_no int, host long, line long"), frequent


def repeated_lines(pages: DataFrame, least: int = 5, id_col: str = "page_id", url_col: str = "url", text_col: str = "wet_text", part: int = PART) -> DataFrame:
    """Distinct (page_id, line_no, host, line) of every line that stands on ``least`` or more pages of its host."""
    return _found(page_lines(pages, least, id_col, url_col, text_col, part), least)[0].dropDuplicates(["page_id", "line_no"])


def line_report(pages: DataFrame, least: int = 5, id_col: str = "page_id", url_col: str = "url", text_col: str = "wet_text", part: int = PART) -> DataFrame:
    """The lines themselves: (host_name, line_text, pages, variants), with one spelling of each line; variants counts its spellings on the whole host."""
    built = page_lines(pages, least, id_col, url_col, text_col, part)
    deleted, frequent = _found(built, least)
    spellings = built.where(F.col("tag") == OF_LINE).groupBy("host", "line").agg(F.count_distinct("variant").alias("variants"))
    sample = deleted.groupBy("host", "line").agg(F.min(F.struct("page_id", "line_no")).alias("at"))
    texts = pages.select(F.col(id_col).alias("page_id"), host_name(F.col(url_col)).alias("host_name"), F.col(text_col).alias("text")).where("host_name is not null")
    shown = frequent.join(sample, ["host", "line"]).join(spellings, ["host", "line"]).join(texts, F.col("at.page_id") == texts["page_id"])
    example = F.element_at(F.split("text", "\n"), (F.col("at.line_no") + 1).cast("int"))
    return shown.select("host_name", F.trim(example).alias("line_text"), F.col("total").alias("pages"), "variants").dropDuplicates()


def without_repeated_lines(pages: DataFrame, least: int = 5, id_col: str = "page_id", url_col: str = "url", text_col: str = "wet_text", part: int = PART) -> DataFrame:
    """Each page's text without the repeated lines: (page_id, clean_text, removed); duplicate rows come out once."""
    lost = repeated_lines(pages, least, id_col, url_col, text_col, part).groupBy("page_id").agg(F.collect_list("line_no").alias("lost"))
    texts = pages.select(F.col(id_col).alias("page_id"), F.col(text_col).alias("text")).dropDuplicates()
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("lost", i))
    joined = texts.join(lost, "page_id", "left")
    return joined.select("page_id", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"), F.coalesce(F.size("lost"), F.lit(0)).alias("removed"))
