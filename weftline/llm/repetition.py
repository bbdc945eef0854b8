"""Repetition inside a single document (problem 4): robust multivariate outliers, then the exact share of repeated words.

A page's statistics are the share of words in passages that stand elsewhere on the page too, the share beyond
each passage's first occurrence, and its length. Passages are runs of ``n`` folded words (no case, punctuation, marks
or digits); a single word between two repeated passages counts with them, so that an exchanged word doesn't break a
passage. The shares are transformed by the logit, the length by the logarithm: a title printed twice or a refrain
makes a larger share of a shorter page, so what is usual depends on the length, as the covariances tell.

Minimum-covariance-determinant estimates of location and scatter are made for the corpus, for each language and for each (language, source) group; a group's estimate is shrunk towards its
language's, that towards the corpus', and that towards ``PRIOR``, each as if the wider one were ``SHRINK`` pages more.
A page is rejected if its squared Mahalanobis distance under one of the three exceeds the chi-square quantile, on the
side of more repetition; a source or a language of which repetition is the rule is so held against the wider ones.
A page without any repetition counts in the estimates as usual ones with little of it do: as if it said a title of ten
words twice (``USUAL``, with its spread), since the logit of nothing tells no more than the length.
``p4_found`` are the rejected pages of which at least two fifths of the words repeat. An estimate is of half of its
pages, and copies of a page count once; a third of all pages may be copies, or near copies, of a repetitive page.

Scale: one pass over the texts. The statistics are counted on a fixed grid, so that a group of any size is at most a
few thousand weighted cells; what is shuffled are statistics (map-side distinct), cells, and one estimate a group.
Nulls: a null or empty text, or one under ``n`` words, has no repetition; null language and host are groups of
their own. Duplicate rows come out once. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import host_name
from weftline.llm.vec import Flat, Words, chunks, splitmix
from weftline.session import cut, shuffle_partitions

N = 5
STEP, EDGE = 0.25, 20.0
CHI2_999_3 = 16.266  # quantile of the chi-square distribution with 3 degrees of freedom at 0.999
CHI2_975_3 = 9.348  # the same at 0.975, for the reweighting step
HALF_3 = 2.455  # a normal distribution's scatter to that of its inner half, in 3 dimensions
D = 3
FLOOR = np.eye(D) * (STEP / 2) ** 2  # least variance: exact fits stay invertible, and a heap of near copies isn't the tightest half
SHRINK = 60.0  # pages that a wider estimate counts for
USUAL = np.log([20.0, 10.0])  # words repeated, and beyond first occurrences, by a title of ten words said twice
SPREAD, TIE = 0.5, 0.9  # standard deviation of their logarithms, and their correlation
PRIOR = (np.array([-1.9, -2.6, 5.0]), np.diag([0.35, 0.35, 0.35]))  # the same on 150 words
NOTHING = -1000  # the cell of a page without repetition
CELL = ["c1", "c2", "c3"]
STATS = "page_id {id}, lang string, host string, copy long, words int, repeated int, excess int, top int, c1 int, c2 int, c3 int"
ESTIMATE = "n double, mean array<double>, scatter array<double>"


def repeated_words(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words in repeated passages, of these not in a first occurrence, count of the top passage) of each text."""
    words = Words(Flat(texts), letters_only=True)
    total = np.diff(words.offsets)
    repeated, excess, top = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    m = words.n - n + 1
    if m <= 0:
        return total, repeated, excess, top
    doc = words.doc()
    with np.errstate(over="ignore"):
        salt = splitmix(doc[:m] + (1 << 44))
        gram = salt.copy()
        for k in range(n):
            gram += words.hash[k : k + m] * (splitmix(np.array([k + (1 << 45)]))[0] | np.uint64(1))
    whole = np.flatnonzero(doc[:m] == doc[n - 1 :])
    order = whole[np.argsort(gram[whole], kind="stable")]  # equal passages side by side, in order of place
    if len(order):
        g = gram[order]
        new = np.r_[True, g[1:] != g[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(g)])
        np.maximum.at(top, doc[order[first]], size)
        often = np.repeat(size, size) > 1

        def covered(starts: np.ndarray) -> np.ndarray:
            edge = np.zeros(words.n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + n, -1)
            return np.cumsum(edge[:-1]) > 0

        for out, starts in ((repeated, order[often]), (excess, order[often & ~new])):
            mark = covered(starts)
            gap = np.zeros_like(mark)
            gap[1:-1] = ~mark[1:-1] & mark[:-2] & mark[2:] & (doc[:-2] == doc[2:])
            out[:] = np.add.reduceat(np.r_[mark | gap, False].astype(np.int64), words.offsets[:-1]) * (total > 0)
    return total, repeated, excess, top


def _grid(x: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(x, -EDGE, EDGE) / STEP).astype(np.int32)


def _logit(part: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (total - part + 0.5))


def _stats(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, stop in chunks(b.column("text").to_pylist()):
            part = b.slice(start, stop - start)
            total, repeated, excess, top = repeated_words(part.column("text").to_pylist(), n)
            cells = [*(np.where(repeated > 0, _grid(_logit(x, total)), NOTHING) for x in (repeated, excess)), _grid(np.log(total + 1.0))]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("page_id", "lang", "host", "copy")), *(pa.array(x.astype(np.int32)) for x in (total, repeated, excess, top, *cells))],
                ["page_id", "lang", "host", "copy", "words", "repeated", "excess", "top", *CELL],
            )


def repetition_statistics(pages: DataFrame, n: int = N, id_col: str = "page_id", text_col: str = "wet_text", lang_col: str = "lang", url_col: str = "url") -> DataFrame:
    """The statistics of each row; see STATS."""
    text = F.col(text_col)
    slim = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(host_name(F.col(url_col)), F.lit("")).alias("host"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return slim.mapInArrow(lambda it: _stats(it, n), STATS.format(id=slim.schema["page_id"].dataType.simpleString()))


# --- minimum covariance determinant over weighted cells

def _moments(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = w @ x / w.sum()
    d = x - mean
    return mean, (d * w[:, None]).T @ d / w.sum() + FLOOR


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return ((d @ np.linalg.inv(cov)) * d).sum(1)


def mcd(x: np.ndarray, w: np.ndarray, share: float = 0.5, starts: int = 4, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of the ``share`` of the weight with the least determinant; concentration steps from fixed starts.

    x: cells, w: their counts. Starts are the medians with the mean deviations, and for many cells random small sets.
    """
    h = share * w.sum()
    order = np.argsort(x, axis=0)
    center = np.array([x[o, k][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)] for k, o in enumerate(order.T)])
    begin = [(center, np.diag(np.square(np.maximum(np.average(np.abs(x - center), axis=0, weights=w), STEP))))]
    if len(x) > 50:
        rng = np.random.default_rng(7)
        for _ in range(starts):
            pick = rng.choice(len(x), 20, replace=False, p=w / w.sum())
            begin.append(_moments(x[pick], np.ones(len(pick))))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for mean, cov in begin:
        last = np.inf
        for _ in range(steps):
            near = np.argsort(_distances(x, mean, cov), kind="stable")
            before = np.cumsum(w[near]) - w[near]
            part = np.zeros(len(x))
            part[near] = np.clip(h - before, 0, w[near])  # the outermost cell counts in part
            mean, cov = _moments(x, part)
            det = float(np.linalg.slogdet(cov)[1])
            if det >= last - 1e-9:
                break
            last = det
        if best is None or last < best[0] - 1e-9:
            best = (last, mean, cov)
    return best[1], best[2]


def estimate(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reweighted estimate: moments of the cells within the 0.975 quantile of the raw one."""
    mean, cov = mcd(x, w)
    inside = _distances(x, mean, cov * HALF_3) <= CHI2_975_3
    return _moments(x[inside], w[inside]) if inside.any() else (mean, cov * HALF_3)


def weighted(cells: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and weights of cells; those without repetition are spread over USUAL's distribution (nine points with its moments)."""
    none = cells[:, 0] == NOTHING
    h, hw = np.array([-np.sqrt(3), 0, np.sqrt(3)]), np.array([1, 4, 1]) / 6
    one, other = (g.ravel() for g in np.meshgrid(h, h))
    words = np.exp(cells[none, 2:] * STEP)
    parts = [np.minimum(np.exp(mean + SPREAD * z), 0.9 * words) for mean, z in zip(USUAL, (one, TIE * one + np.sqrt(1 - TIE**2) * other))]
    x = np.stack([*(np.log(p / (words - p)).ravel() for p in parts), np.repeat(cells[none, 2] * STEP, 9)], 1)
    return np.concatenate([cells[~none] * STEP, x]), np.concatenate([w[~none], (w[none, None] * np.outer(hw, hw).ravel()).ravel()])


def _estimate(group: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    w = group["n"].to_numpy(float)
    mean, cov = estimate(*weighted(group[CELL].to_numpy(float), w))
    return pd.DataFrame([[*group.iloc[0][keys], w.sum(), mean.tolist(), cov.ravel().tolist()]], columns=[*keys, "n", "mean", "scatter"])


def _mixed(n: Column, own: Column, wider: Column) -> Column:
    return F.zip_with(own, wider, lambda x, y: (n * x + SHRINK * y) / (n + SHRINK))


def _shrunk(own: DataFrame, wider: DataFrame, on: str) -> DataFrame:
    """``own`` with its estimates drawn towards those of ``wider`` (on, mean, scatter); one row of ``wider`` a key."""
    both = own.join(wider.select(on, F.col("mean").alias("_m"), F.col("scatter").alias("_s")), on)
    return both.withColumn("mean", _mixed(F.col("n"), F.col("mean"), F.col("_m"))).withColumn("scatter", _mixed(F.col("n"), F.col("scatter"), F.col("_s"))).drop("_m", "_s")


def _precisions(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for name in names:
            b[name] = [np.linalg.inv(np.array(x).reshape(D, D)).ravel().tolist() for x in b[name]]
        yield b


def _distance(mean: str, precision: str) -> Column:
    """Squared Mahalanobis distance of a row of statistics."""
    logit = lambda c: F.log((F.col(c) + 0.5) / (F.col("words") - F.col(c) + 0.5))
    d = [x - F.col(mean)[i] for i, x in enumerate((logit("repeated"), logit("excess"), F.log(F.col("words") + 1.0)))]
    return reduce(lambda a, b: a + b, (d[i] * d[j] * F.col(precision)[i * D + j] for i in range(D) for j in range(D)))


def estimates(stats: DataFrame) -> DataFrame:
    """One row for each (lang, host): location and precision of the group, its language and the corpus."""
    some = stats.where("words > 0").groupBy("lang", "copy", *CELL).agg(F.min("host").alias("host"))  # copies count once, at the first of their hosts
    cells = cut(some.groupBy("lang", "host", *CELL).agg(F.count("*").alias("n")), "cells")
    spread = lambda df, keys: df.repartition(shuffle_partitions(df.sparkSession), *keys)  # noqa: E731  (small rows, much work)
    by = lambda df, keys: spread(df, keys).groupBy(*keys).applyInPandas(lambda g: _estimate(g, keys), ", ".join(f"{k} string" for k in keys) + ", " + ESTIMATE)
    wide = cells.groupBy("lang", *CELL).agg(F.sum("n").alias("n"))
    n, mean, scatter = 0.0, *PRIOR
    for r in by(wide.groupBy(*CELL).agg(F.sum("n").alias("n")).withColumn("scope", F.lit("*")), ["scope"]).collect():  # one row, or none
        n = r["n"]
        mean, scatter = ((n * np.array(own).reshape(x.shape) + SHRINK * x) / (n + SHRINK) for own, x in ((r["mean"], mean), (r["scatter"], scatter)))
    literal = lambda x: F.array(*map(F.lit, x.ravel().tolist()))
    languages = by(wide, ["lang"]).withColumns({"mean_all": literal(mean), "scatter_all": literal(scatter)})
    languages = cut(languages.withColumn("mean", _mixed(F.col("n"), F.col("mean"), F.col("mean_all"))).withColumn("scatter", _mixed(F.col("n"), F.col("scatter"), F.col("scatter_all"))), "languages")
    groups = _shrunk(by(cells, ["lang", "host"]), languages, "lang")
    # pages whose copies count at another host have no cells of their own there: their language's estimate stands in
    named = stats.where("repeated > 0").select("lang", "host").distinct().join(groups.select("lang", "host", F.col("mean").alias("m"), F.col("scatter").alias("s")), ["lang", "host"], "left")
    every = named.join(languages, "lang").select(
        "lang", "host", F.coalesce("m", "mean").alias("mean_group"), F.coalesce("s", "scatter").alias("group"), F.col("mean").alias("mean_lang"), F.col("scatter").alias("language"), "mean_all", F.col("scatter_all").alias("corpus")
    )
    return every.mapInPandas(lambda it: _precisions(it, ["group", "language", "corpus"]), every.schema)


def rejected(stats: DataFrame, cutoff: float = CHI2_999_3) -> DataFrame:
    """The rows of ``stats`` beyond the cutoff of their group's, their language's or the corpus' estimate, on the side of more repetition."""
    joined = stats.where("repeated > 0").join(estimates(stats), ["lang", "host"])
    share = F.log((F.col("repeated") + 0.5) / (F.col("words") - F.col("repeated") + 0.5))
    beyond = [(_distance(m, p) > cutoff) & (share > F.col(m)[0]) for m, p in (("mean_group", "group"), ("mean_lang", "language"), ("mean_all", "corpus"))]
    return joined.where(beyond[0] | beyond[1] | beyond[2]).select(stats.columns)


def outlying_pages(pages: DataFrame, n: int = N, cutoff: float = CHI2_999_3, **cols: str) -> DataFrame:
    """Pages outlying for more repetition in their group, language or corpus, with their statistics; each page once."""
    return rejected(cut(repetition_statistics(pages, n, **cols), "repetition"), cutoff).dropDuplicates(["page_id"])


def repetitive_pages(pages: DataFrame, share: float = 0.4, n: int = N, cutoff: float = CHI2_999_3, **cols: str) -> DataFrame:
    """The outlying pages of which at least ``share`` of the words repeat, with their statistics."""
    return outlying_pages(pages, n, cutoff, **cols).where(F.col("repeated") >= share * F.col("words"))
