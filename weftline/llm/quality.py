"""Per-document text quality statistics (problem 6), and prose told from lists, tables and junk by a Gaussian mixture.

Each text has one vector of statistics (see STATISTICS). Their mixture of Gaussians is fitted by expectation-
maximisation over all rows, on statistics standardised over all rows; the components start at the means of
inspected examples of prose, list, table and junk, and a component has the class of the examples it explains best.
A text that the mixture doesn't find clearly prose is then checked line by line: it is no prose if more than half
of its words' characters stand in lines that are no running prose.

Scale: the statistics are made in one pass and written once, as ten numbers a row. An iteration is one pass over
them that sends k (1 + d + d^2) sums a task, added up before the driver sees them. The examples are a fixed set.
Nulls: a null text, or one without a sign but white space, has zero statistics and the class ``empty``. Rows are
judged on their own, so duplicates and ties change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.vec import DIGIT, LETTER, MARK, SPACE, Flat, Words, chunks
from weftline.session import cut

STATISTICS = ("words", "word_length", "stop_share", "symbol_share", "digit_share", "line_words", "ended_share", "marked_share", "separators", "prose_share")
CLASSES = ("prose", "list", "table", "junk")
ENDS = np.array([ord(c) for c in ".!?…:;\"”’)"], np.uint32)
SEPARATORS = np.array([ord(c) for c in "|/·»›•,;:=–—<>{}[]_#\t"], np.uint32)
MARKERS = np.array([ord(c) for c in "-*•●–—▪◦+#→✓■"], np.uint32)


# --- statistics

def line_prose(words: np.ndarray, stops: np.ndarray, letters: np.ndarray, signs: np.ndarray, digits: np.ndarray, separators: np.ndarray, ended: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which lines are running prose, from their counts: words enough for a sentence, common words among them, few other signs."""
    n = np.maximum(words, 1)
    written = np.maximum(signs, 1)
    worded = (stops >= 0.12 * n) & (letters >= 0.72 * written) & (separators <= 0.34 * n)
    return worded & ((words >= 7) | ((words >= 3) & ended & ~marked & (digits <= 0.2 * written)))


def text_statistics(texts: list[str | None], stop_hashes: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    flat = Flat(texts)
    w = Words(flat)
    n_texts = flat.n
    cp, kind = flat.cp, flat.kind
    newline = np.flatnonzero(cp == 10)
    n_lines = len(newline) + 1
    starts = np.r_[0, newline + 1]
    text_of_line = np.searchsorted(flat.starts, starts, "right") - 1
    text_of_line = np.minimum(text_of_line, n_texts - 1)

    def per_line(at: np.ndarray) -> np.ndarray:
        edge = np.searchsorted(at, np.r_[starts, len(cp) + 1])
        return np.diff(edge)

    stop = np.isin(w.hash, stop_hashes)
    sign = np.flatnonzero((kind != SPACE) & (kind != MARK))
    words, stops = per_line(w.at), per_line(w.at[stop])
    letters, digits, signs = per_line(np.flatnonzero(kind == LETTER)), per_line(np.flatnonzero(kind == DIGIT)), per_line(sign)
    separators = per_line(np.flatnonzero(np.isin(cp, SEPARATORS)))
    edge = np.searchsorted(sign, np.r_[starts, len(cp) + 1])
    filled = edge[1:] > edge[:-1]
    ended, marked = np.zeros(n_lines, bool), np.zeros(n_lines, bool)
    if len(sign):
        last = cp[sign[np.maximum(edge[1:] - 1, 0)]]
        first = cp[sign[np.minimum(edge[:-1], len(sign) - 1)]]
        ended, marked = filled & np.isin(last, ENDS), filled & np.isin(first, MARKERS)
    prose = line_prose(words, stops, letters, signs, digits, separators, ended, marked)
    short = filled & ~prose & ~marked & (words < 7) & (words > 0) & (digits == 0) & (separators == 0) & (letters >= 0.9 * np.maximum(signs, 1))
    before, after = np.r_[False, prose[:-1]], np.r_[prose[1:], False]
    prose |= short & before & (after | (np.r_[text_of_line[1:], -1] != text_of_line))  # the end of a wrapped paragraph

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(text_of_line, x, n_texts)

    t_words, t_signs, t_lines = total(words), np.maximum(total(signs), 1), np.maximum(total(filled), 1)
    some = np.maximum(t_words, 1)
    weight = np.where(words > 0, np.maximum(signs, 1), signs)
    out = np.stack(
        [
            np.log1p(t_words), np.log1p(total(letters) / some), total(stops) / some, (t_signs - total(letters) - total(digits)) / t_signs, total(digits) / t_signs,
            np.log1p(t_words / t_lines), total(ended) / t_lines, total(marked) / t_lines, np.log1p(total(separators) / some), total(weight * prose) / np.maximum(total(weight), 1),
        ], 1,
    )
    out[total(signs) == 0] = 0
    return out


def _statistics(batches: Iterator[pa.RecordBatch], stop_hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for start, stop in chunks(texts):
            x = text_statistics(texts[start:stop], stop_hashes)
            yield pa.RecordBatch.from_arrays([b.column("id").slice(start, stop - start), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["id", *STATISTICS])


def stop_hashes(stop_words: DataFrame, word_col: str = "word", most: int = 100_000) -> np.ndarray:
    """Hashes of the folded common words; their table must have at most ``most`` rows."""
    rows = stop_words.select(word_col).where(F.col(word_col).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    return np.unique(Words(Flat([r[0] for r in rows])).hash)


def quality_statistics(texts: DataFrame, stop_words: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, the ten STATISTICS) of each row; logarithms of counts, and shares."""
    hashes = texts.sparkSession.sparkContext.broadcast(stop_hashes(stop_words))
    slim = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema[0].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS)
    return slim.mapInArrow(lambda it: _statistics(it, hashes.value), schema)


# --- the mixture

@dataclass
class Mixture:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    classes: list[str]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def log_joint(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), len(self.weights)))
        for k in range(len(self.weights)):
            chol = np.linalg.cholesky(self.covariances[k])
            y = np.linalg.solve(chol, (z - self.means[k]).T)
            out[:, k] = np.log(self.weights[k]) - 0.5 * (y**2).sum(0) - np.log(np.diag(chol)).sum()
        return out

    def posterior(self, z: np.ndarray) -> np.ndarray:
        p = self.log_joint(z)
        p = np.exp(p - p.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], 1)


def _sums(batches: Iterator[pa.RecordBatch], model: Mixture) -> Iterator[pa.RecordBatch]:
    k, d = model.means.shape
    n, s, q = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for b in batches:
        z = model.standard(_rows(b))
        p = model.posterior(z)
        n += p.sum(0)
        s += p.T @ z
        for i in range(k):
            q[i] += (z * p[:, i : i + 1]).T @ z
    flat = np.concatenate([n[:, None], s, q.reshape(k, -1)], 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), flat.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(flat.shape[1]), k).astype(np.int32)), pa.array(flat.ravel())], ["k", "i", "v"])


def fit(stats: DataFrame, examples: list[tuple[str, np.ndarray]], iterations: int = 12, ridge: float = 0.05) -> Mixture:
    """Expectation-maximisation from the means of the examples' groups; each group is (class, its rows of statistics)."""
    d = len(STATISTICS)
    moments = stats.agg(F.count("*"), *(F.avg(s) for s in STATISTICS), *(F.stddev_pop(s) for s in STATISTICS)).first()
    mean = np.array([x or 0.0 for x in moments[1 : d + 1]])
    scale = np.array([x if x and x > 1e-6 else 1.0 for x in moments[d + 1 :]])
    k = len(examples)
    means = np.stack([((x - mean) / scale).mean(0) for _, x in examples])
    model = Mixture(mean, scale, np.full(k, 1 / k), means, np.stack([np.eye(d) * 0.5] * k), [c for c, _ in examples])
    for _ in range(iterations if moments[0] else 0):
        sent = stats.sparkSession.sparkContext.broadcast(model)
        rows = stats.mapInArrow(lambda it: _sums(it, sent.value), "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros((k, 1 + d + d * d))
        flat[rows["k"], rows["i"]] = rows["v"]
        n = flat[:, 0]
        alive = n > d
        new_means, new_cov, weights = model.means.copy(), model.covariances.copy(), np.maximum(n, 1e-3)
        for i in np.flatnonzero(alive):
            new_means[i] = flat[i, 1 : d + 1] / n[i]
            new_cov[i] = flat[i, d + 1 :].reshape(d, d) / n[i] - np.outer(new_means[i], new_means[i]) + np.eye(d) * ridge
        moved = np.abs(new_means - model.means).max()
        model = Mixture(mean, scale, weights / weights.sum(), new_means, new_cov, model.classes)
        sent.unpersist()
        if moved < 1e-3:
            break
    return Mixture(mean, scale, model.weights, model.means, model.covariances, _classes(model, examples))


def _classes(model: Mixture, examples: list[tuple[str, np.ndarray]]) -> list[str]:
    """The class of the examples that a component explains best; one without any takes its nearest example's."""
    votes = np.zeros((len(model.weights), len(CLASSES)))
    for c, x in examples:
        votes[:, CLASSES.index(c)] += model.posterior(model.standard(x)).mean(0)
    groups = np.stack([model.standard(x).mean(0) for _, x in examples])
    nearest = [examples[int(np.argmin(((groups - m) ** 2).sum(1)))][0] for m in model.means]
    return [CLASSES[int(np.argmax(v))] if v.sum() > 0.2 else near for v, near in zip(votes, nearest)]


def inspected_examples(prose: list[str], hashes: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Groups of examples: given prose, and the usual forms of list, table and junk, written with the prose's own words."""
    words = [w.strip(".,!?") for t in prose for w in t.split() if len(w) > 3] or ["word"]
    rng = np.random.default_rng(11)
    some = lambda n: [words[i] for i in rng.integers(0, len(words), n)]
    number = lambda: str(rng.integers(1, 90_000))
    forms = {
        "bullets": ("list", lambda: "\n".join("- " + " ".join(some(rng.integers(1, 4))) for _ in range(15))),
        "contents": ("list", lambda: "\n".join(f"{i}. {' '.join(some(2))} {'.' * 14} {number()}" for i in range(1, 15))),
        "menu": ("list", lambda: " | ".join(some(20))),
        "tags": ("list", lambda: " ".join("#" + w for w in some(24))),
        "commas": ("list", lambda: ", ".join(" ".join(some(2)) for _ in range(20))),
        "one a line": ("list", lambda: "\n".join(some(40))),
        "pairs": ("table", lambda: "\n".join(f"{some(1)[0]} : {some(1)[0]}" for _ in range(16))),
        "form": ("table", lambda: "\n".join(f"{some(1)[0]}: {rng.choice(['_____', '[ ]', 'N/A', '......'])}" for _ in range(16))),
        "columns": ("table", lambda: "\n".join("\t".join([*some(1), number(), *some(1), number()]) for _ in range(14))),
        "scores": ("table", lambda: "\n".join(" ".join([number()[:2], *some(1), *(number()[:2] for _ in range(5))]) for _ in range(14))),
        "numbers": ("junk", lambda: "\n".join(f"{number()}-{number()}" for _ in range(30))),
        "links": ("junk", lambda: "\n".join(f"https://{some(1)[0]}.example/{some(1)[0]}?p={number()}" for _ in range(12))),
        "code": ("junk", lambda: "\n".join(f'<div class="{some(1)[0]}"><a href="/{some(1)[0]}">{some(1)[0]}</a></div>\nvar {some(1)[0]}={number()};' for _ in range(8))),
        "letters": ("junk", lambda: " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 14))) for _ in range(40))),
        "signs": ("junk", lambda: "\n".join("".join(rng.choice(list("★☆→●✓±©œ·€Ã"), 24)) for _ in range(14))),
    }
    lines = ["\n".join(prose[i : i + 3]) for i in range(0, len(prose), 3)] or ["word"]
    plain = [t.lower().replace(".", "").replace(",", "") for t in lines]
    groups = [("prose", lines), ("prose", plain)] + [(c, [make() for _ in range(12)]) for c, make in forms.values()]
    return [(c, text_statistics(list(texts), hashes)) for c, texts in groups]


def _judge(batches: Iterator[pa.RecordBatch], model: Mixture) -> Iterator[pa.RecordBatch]:
    by_class = np.array([[c == name for c in model.classes] for name in CLASSES], float)
    for b in batches:
        x = _rows(b)
        p = model.posterior(model.standard(x)) @ by_class.T
        best = np.array([*CLASSES, "empty"])[np.where((x == 0).all(1), len(CLASSES), p.argmax(1))]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best.astype(object), pa.string()), pa.array(np.ascontiguousarray(p[:, 0])), b.column("prose_share")], ["id", "class", "p_prose", "prose_share"])


def judged(texts: DataFrame, stop_words: DataFrame, prose: DataFrame, id_col: str = "id", text_col: str = "text", prose_col: str = "text", most_examples: int = 1000) -> DataFrame:
    """(id, class, p_prose, prose_share) of each row. ``prose``: inspected examples of prose, at most ``most_examples`` rows."""
    spark: SparkSession = texts.sparkSession
    stats = cut(quality_statistics(texts, stop_words, id_col, text_col), "quality")
    examples = [r[0] for r in prose.select(prose_col).where(F.length(prose_col) > 0).orderBy(F.md5(prose_col)).limit(most_examples).collect()]
    model = spark.sparkContext.broadcast(fit(stats, inspected_examples(examples, stop_hashes(stop_words))))
    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(lambda it: _judge(it, model.value), f"id {kind}, class string, p_prose double, prose_share double")


def not_prose(verdicts: DataFrame, sure: float = 0.999) -> DataFrame:
    """Rows that the mixture doesn't hold for prose with ``sure`` or more, and whose lines are for more than half no prose."""
    return verdicts.where((F.col("class") != "empty") & (F.col("p_prose") < sure) & (F.col("prose_share") < 0.5))
