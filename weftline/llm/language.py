"""Languages of documents and of the passages of mixed ones (problem 1): multilingual mixture inference.

A language's n-gram model is counted from clean samples: hashed letter n-grams of 2 to 4 over folded text, whole
words, and the common words. A document is a mixture of languages over its sentences: expectation-maximisation
estimates its proportions from the sentences' n-gram likelihoods, and languages are added one at a time while the
penalised likelihood grows. Each sentence then belongs to the language with the greatest posterior, neighbouring
sentences of one language are a passage, and a language counts if at least one whole sentence is in it.

Scale: one pass over the texts without a shuffle; the model is a fixed table of 2^17 rows sent to the workers. The
samples are bounded (``most_samples`` rows, the labelled sample that the model is fitted on); all common words count, and
more than ``most_words`` are an error. All records and whole texts are judged.
Nulls: a null text, or one with fewer than ``least_words`` known words, has no language. Rows are judged one by
one, so duplicates and ties change nothing (equal likelihoods go to the first language by code). An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.vec import LETTER, Flat, Words, chunks, list_array, splitmix, tables

BITS = 17
ORDERS = (2, 3, 4)
WHOLE = 5  # the order under which whole words are counted
BOUND = np.uint32(1)
LANGUAGES = ("eng_Latn", "fra_Latn", "hau_Latn", "ibo_Latn", "pcm_Latn", "yor_Latn")
# fixed values: spellings of labels
SPELLINGS = {
    "eng_Latn": ("eng", "en", "english"),
    "fra_Latn": ("fra", "fr", "fre", "french", "français", "francais"),
    "hau_Latn": ("hau", "ha", "hausa", "harshen hausa"),
    "ibo_Latn": ("ibo", "ig", "igbo", "asụsụ igbo"),
    "pcm_Latn": ("pcm", "pidgin", "nigerian pidgin", "naija", "naijá"),
    "yor_Latn": ("yor", "yo", "yoruba", "yorùbá"),
}


def known_label(label: Column) -> Column:
    """A label's code, whatever its spelling; null for missing labels, placeholders and unknown languages."""
    clean = F.regexp_replace(F.lower(F.trim(label)), r"[-_](latn|latin|ng)$", "")
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)]
    return F.element_at(F.create_map(*pairs), clean)


@dataclass
class Model:
    """``scores[g, l]``: log probability of hashed n-gram g in language l, less the mean over languages."""

    languages: list[str]
    scores: np.ndarray


def _grams(flat: Flat, words: Words, some: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(table rows of the n-grams of each order by place, each word's first place), of all words or of ``some``. A place is a letter or a word's bound."""
    first, length = (words.first, words.length) if some is None else (words.first[some], words.length[some])
    lengths = length + max(ORDERS)  # a word's letters between bounds, so that no n-gram reaches into the next word
    starts = np.r_[0, np.cumsum(lengths)]
    ends = np.cumsum(length)
    at = np.arange(int(length.sum())) - np.repeat(ends - length, length)
    stream = np.full(starts[-1] + max(ORDERS), BOUND, np.uint32)
    stream[np.repeat(starts[:-1], length) + 1 + at] = tables()[1][flat.cp[words.kept[np.repeat(first, length) + at]]]
    places = np.repeat(starts[:-1], length + 1) + np.arange(int(length.sum()) + len(length)) - np.repeat(ends - length + np.arange(len(length)), length + 1)
    out = []
    values = tables()[2]
    symbols = values[stream]
    n = int(starts[-1])
    with np.errstate(over="ignore"):
        for order in ORDERS:
            h = np.full(n, order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for i in range(order):
                h = (h ^ symbols[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            out.append((h[places] >> np.uint64(64 - BITS)).astype(np.int32))
    return out, np.cumsum(length + 1) - (length + 1)


def _word_rows(hashes: np.ndarray) -> np.ndarray:
    return (splitmix(hashes + np.uint64(WHOLE)) >> np.uint64(64 - BITS)).astype(np.int32)


def word_scores(flat: Flat, words: Words, model: Model) -> np.ndarray:
    """Each word's log likelihood by language; every different word of the batch is scored once."""
    different, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
    rows, first = _grams(flat, words, one)
    return (sum(np.add.reduceat(model.scores[r], first, axis=0) for r in rows) + 2 * model.scores[_word_rows(different)])[which]


def train(samples: list[tuple[str, str]], common: list[tuple[str, str]], smoothing: float = 0.3) -> Model:
    """``samples``: (language, text); ``common``: (language, common word)."""
    languages = sorted({x for x, _ in samples})
    counts = np.zeros((1 << BITS, len(languages)))
    for k, name in enumerate(languages):
        for texts, weight in (([t for x, t in samples if x == name], 1.0), ([" ".join(w for x, w in common if x == name)], 1.0)):
            flat = Flat(texts)
            words = Words(flat, letters_only=True)
            rows, _ = _grams(flat, words)
            for r in rows:
                counts[:, k] += weight * np.bincount(r, minlength=1 << BITS)
            counts[:, k] += 2 * weight * np.bincount(_word_rows(words.hash), minlength=1 << BITS)
    used = counts.sum(1) > 0
    p = np.log((counts + smoothing) / (counts.sum(0) + smoothing * used.sum()))
    p -= p.mean(1, keepdims=True)
    p[~used] = 0  # an n-gram of no sample says nothing
    return Model(languages, p.astype(np.float32))


def _sentence_starts(flat: Flat, words: Words, most_words: int) -> np.ndarray:
    """First word of each sentence: after a line break or . ! ?, at a new text, and every ``most_words`` words of a longer one."""
    cp = flat.cp
    stop = np.isin(cp, np.array([46, 33, 63, 0x2026], np.uint32))
    ends = np.zeros(len(cp), bool)
    ends[cp == 10] = True
    ends[:-1] |= stop[:-1] & (flat.kind[1:] == 3)
    passed = np.cumsum(ends)[words.at] if words.n else np.zeros(0, np.int64)
    first = np.r_[True, passed[1:] != passed[:-1]] if words.n else np.zeros(0, bool)
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, words.n])
    if len(size) and size.max() > most_words:  # sentences without punctuation
        parts = -(-size // most_words)
        step = -(-size // parts)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + k * np.repeat(step, parts)
    return start


def infer(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(chosen languages of each document, sentence posteriors) from sentence log likelihoods.

    Forward selection: the set with the best penalised likelihood among those that add one language, with the
    proportions of each set estimated by ``rounds`` steps of expectation-maximisation.
    """
    n_lang = scores.shape[1]
    some = np.bincount(doc, minlength=n_docs) > 0

    def sums(x: np.ndarray, doc: np.ndarray = doc, some: np.ndarray = some) -> np.ndarray:
        out = np.zeros((len(some), *x.shape[1:]))
        if len(x):
            out[some] = np.add.reduceat(x, np.searchsorted(doc, np.flatnonzero(some)))
        return out

    def em(allowed: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each of ``docs``, posteriors of their sentences) with the languages that each is allowed."""
        place = np.full(n_docs, -1)
        place[docs] = np.arange(len(docs))
        rows = place[doc] >= 0
        own, of = scores[rows], place[doc[rows]]
        total_of = lambda x: sums(x, of, some[docs])
        with np.errstate(divide="ignore"):
            log_pi = np.where(allowed, -np.log(np.maximum(allowed.sum(1, keepdims=True), 1)), -np.inf)
            for step in range(rounds):
                joint = own + log_pi[of]
                top = joint.max(1, keepdims=True)
                p = np.exp(joint - top)
                total = p.sum(1, keepdims=True)
                p /= total
                if step < rounds - 1:
                    log_pi = np.log(np.where(allowed, np.maximum(total_of(p) / np.maximum(total_of(np.ones(len(p))), 1)[:, None], 1e-3), 0))
        return total_of((np.log(total) + top)[:, 0]), p

    single = sums(scores)
    chosen = np.zeros((n_docs, n_lang), bool)
    chosen[np.arange(n_docs), single.argmax(1)] = True
    value = single.max(1)
    open_docs = some.copy()
    for _ in range(n_lang - 1):
        # the gain of adding a language is at most what its own sentences gain
        best_now = np.where(chosen[doc], scores, -np.inf).max(1)
        promise = sums(np.maximum(scores - best_now[:, None], 0))
        promise[chosen] = 0
        best, added = value.copy(), np.full(n_docs, -1)
        for add in np.argsort(-promise, axis=1, kind="stable").T:  # every language whose gain may exceed the penalty
            docs = np.flatnonzero(open_docs & (promise[np.arange(n_docs), add] > penalty))
            if not len(docs):
                break
            trial = chosen[docs]
            trial[np.arange(len(docs)), add[docs]] = True
            after = em(trial, docs)[0] - penalty * chosen[docs].sum(1)  # for each language but the first
            better = after > best[docs]
            best[docs[better]] = after[better]
            added[docs[better]] = add[docs[better]]
        open_docs &= added >= 0
        if not open_docs.any():
            break
        chosen[open_docs, added[open_docs]] = True
        value[open_docs] = best[open_docs]
    return chosen, em(chosen, np.arange(n_docs))[1]


@dataclass
class Settings:
    penalty: float = 14.0
    damping: float = 0.5  # n-grams overlap; their log probabilities are not independent
    least_words: int = 3  # of a text
    least_sentence: int = 4  # words of a whole sentence
    most_words: int = 30


def languages_of(texts: list[str | None], model: Model, s: Settings) -> tuple[list[list[tuple[int, float]]], list[list[tuple[int, int, int, float]]]]:
    """(languages and their shares of the words, passages as start, end, language, confidence) of each text."""
    flat = Flat(texts)
    words = Words(flat, letters_only=True)
    found: list[list[tuple[int, float]]] = [[] for _ in texts]
    passages: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not words.n:
        return found, passages
    per_word = word_scores(flat, words, model)
    start = _sentence_starts(flat, words, s.most_words)
    scores = np.add.reduceat(per_word, start, axis=0).astype(np.float64) * s.damping
    size = np.diff(np.r_[start, words.n])
    doc = np.searchsorted(flat.starts, words.at[start], "right") - 1
    known = np.add.reduceat((np.abs(per_word).max(1) > 0.5).astype(np.int64), start)
    chosen, p = infer(scores, doc, len(texts), s.penalty)
    best = p.argmax(1)
    sure = p[np.arange(len(p)), best]
    enough = np.bincount(doc, known, len(texts)) >= s.least_words
    whole = (known >= s.least_sentence) & (sure > 0.5)
    weight = np.zeros((len(texts), len(model.languages)))
    counts = np.zeros_like(weight)
    np.add.at(weight, (doc, best), size)
    np.add.at(counts, (doc, best), whole)
    counts[np.arange(len(texts)), weight.argmax(1)] += 1  # the main language needs no whole sentence
    keep = chosen & (counts > 0) & (weight > 0) & enough[:, None]
    share = weight / np.maximum(weight.sum(1, keepdims=True), 1)
    for d, k in zip(*np.nonzero(keep)):
        found[d].append((int(k), float(share[d, k])))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(doc)] - 1
    weighted = np.add.reduceat(sure * size, begin) / np.add.reduceat(size, begin)
    until = np.r_[words.at[start[1:]], len(flat.cp)]
    for b, e, c in zip(begin, last, weighted):
        d = doc[b]
        if enough[d]:
            at = int(flat.starts[d])
            end = min(int(until[e]), int(flat.starts[d + 1]) - 1)
            passages[d].append((int(words.at[start[b]]) - at, end - at, int(best[b]), float(c)))
    return found, passages


IDENTIFIED = "id {id}, languages array<string>, shares array<double>, starts array<int>, ends array<int>, passage_languages array<string>, confidences array<double>, confidence double"


def _identify(batches: Iterator[pa.RecordBatch], model: Model, s: Settings) -> Iterator[pa.RecordBatch]:
    names = np.array(model.languages, object)
    for b in batches:
        texts = b.column("text").to_pylist()
        for start, stop in chunks(texts):
            found, passages = languages_of(texts[start:stop], model, s)
            nf, np_ = np.array([len(x) for x in found]), np.array([len(x) for x in passages])
            flat_f, flat_p = [y for x in found for y in x], [y for x in passages for y in x]
            column = lambda rows, i, kind: pa.array([r[i] for r in rows], kind)
            named = lambda rows, i: pa.array([names[r[i]] for r in rows], pa.string())
            total = [sum((e - a) * c for a, e, _, c in x) / max(1, sum(e - a for a, e, _, _ in x)) if x else 0.0 for x in passages]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").slice(start, stop - start), list_array(named(flat_f, 0), nf), list_array(column(flat_f, 1, pa.float64()), nf),
                    list_array(column(flat_p, 0, pa.int32()), np_), list_array(column(flat_p, 1, pa.int32()), np_), list_array(named(flat_p, 2), np_), list_array(column(flat_p, 3, pa.float64()), np_), pa.array(total, pa.float64()),
                ],
                ["id", "languages", "shares", "starts", "ends", "passage_languages", "confidences", "confidence"],
            )


def identified(texts: DataFrame, samples: DataFrame, common: DataFrame, settings: Settings | None = None, most_samples: int = 20_000, most_words: int = 1_000_000, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Each row's languages with their shares, its passages with language and confidence, and its confidence; see IDENTIFIED."""
    order = [F.md5(F.concat_ws("|", "lang", "text"))]
    rows = samples.select("lang", "text").where("lang is not null and text is not null").orderBy(*order).limit(most_samples).collect()
    words = common.select("lang", "word").where("lang is not null and word is not null").distinct().limit(most_words + 1).collect()
    if len(words) > most_words:
        raise ValueError(f"more than {most_words} common words")
    words = sorted(tuple(r) for r in words)
    sent = texts.sparkSession.sparkContext.broadcast((train([tuple(r) for r in rows], words), settings or Settings()))
    slim = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda it: _identify(it, *sent.value), IDENTIFIED.format(id=slim.schema[0].dataType.simpleString()))


def mislabelled(texts: DataFrame, found: DataFrame, id_col: str = "id", lang_col: str = "lang") -> DataFrame:
    """(id, label, languages) of rows whose label is missing or not their one language."""
    label = texts.select(F.col(id_col).alias("id"), known_label(F.col(lang_col)).alias("label")).distinct()
    both = found.where(F.size("languages") > 0).join(label, "id")
    right = (F.size("languages") == 1) & (F.element_at("languages", 1) == F.col("label"))
    return both.where(~F.coalesce(right, F.lit(False))).select("id", "label", "languages")
