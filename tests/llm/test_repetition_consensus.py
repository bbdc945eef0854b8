import random

import numpy as np
import pytest

from weftline.llm import consensus as C
from weftline.llm import repetition as R


def brute(text, n=5):
    from weftline.llm.vec import Flat, Words

    w = Words(Flat([text]), letters_only=True).hash.tolist()
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    seen, cover, later = {}, [False] * len(w), [False] * len(w)
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    first = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover[i : i + n] = [True] * n
            if g in first:
                later[i : i + n] = [True] * n
            first.add(g)

    def filled(m):
        return sum(x or (0 < i < len(m) - 1 and m[i - 1] and m[i + 1]) for i, x in enumerate(m))

    return len(w), filled(cover), filled(later), max(seen.values(), default=0)


def test_repeated_words_equal_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 120))) for _ in range(40)] + ["", None, "daya", "a b c d e " * 30]
    got = list(zip(*(x.tolist() for x in R.repeated_words(texts))))
    assert got == [brute(t) for t in texts]


def test_mcd_ignores_a_third_of_outliers():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.3, (700, 3)), rng.normal(5, 0.3, (240, 3))]
    mean, _ = R.mcd(x, np.ones(len(x)))
    assert np.abs(mean).max() < 0.2
    mean, cov = R.estimate(x, np.ones(len(x)))
    bad = R._distances(x, mean, cov) > R.CHI2_975_3
    assert bad[700:].all() and bad[:700].mean() < 0.1


def test_mcd_of_identical_rows_and_one_row():
    mean, cov = R.estimate(np.zeros((1, 3)), np.array([500.0]))
    assert not mean.any() and np.allclose(cov, R.FLOOR)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, lang string, wet_text string, words int")


def text(seed, n=150):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_repetitive_pages(spark):
    plain = [(i, f"https://a.example/{i}", "hau_Latn", text(i)) for i in range(90)]
    sentence = "wannan jumla ce mai maimaita kanta sau da yawa a shafi"
    bad = [(100, "https://a.example/x", "hau_Latn", "\n".join(f"{i}. {sentence.upper() if i % 2 else sentence}" for i in range(20))), (101, None, None, text(7) + "\n" + text(7))]
    odd = [(102, None, None, None), (103, "u", "", ""), (104, "https://a.example/t", "hau_Latn", f"{sentence}\n{sentence}\n{text(5)}")]
    found = R.repetitive_pages(pages(spark, plain + bad + bad[:1] + odd))
    assert sorted(r["page_id"] for r in found.collect()) == [100, 101]
    assert R.repetitive_pages(pages(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [50, 200])
def test_copies_of_a_repetitive_page_are_found(spark, copies):
    plain = [(i, f"https://a.example/{i}", "hau_Latn", text(i)) for i in range(100)]
    copied = "\n".join(line for i in range(4) for line in [text(1000 + i, 24)] * 3) + "\n" + text(2000, 100)
    bad = [(1000 + i, f"https://b.example/{i}", "hau_Latn", copied) for i in range(copies)]
    other = [(5000, "https://c.example/x", "ibo_Latn", text(3000, 40) + "\n" + text(3000, 40) + "\n" + text(3001, 60))]
    found = R.repetitive_pages(pages(spark, plain + bad + other)).collect()
    assert sorted(r["page_id"] for r in found) == [*(r[0] for r in bad), 5000]


def test_outliers_count_a_page_once_and_stand_a_third_of_copies(spark):
    plain = [(i, f"https://a.example/{i}", "hau_Latn", text(i)) for i in range(100)]
    copied = "\n".join(line for i in range(4) for line in [text(1000 + i, 24)] * 3)
    bad = [(1000 + i, f"https://b.example/{i}", "hau_Latn", copied) for i in range(50)]
    for rows in (plain + bad, plain + bad[:1] * 200):
        assert sorted(r["page_id"] for r in R.outlying_pages(pages(spark, rows)).collect()) == sorted({r[0] for r in rows if r[0] >= 1000})


def test_a_third_of_near_copies_is_no_norm():
    """Statistics of 600 usual pages, of which half have no repetition, and of 300 near copies of a repetitive page."""
    rng = np.random.default_rng(5)
    n = np.r_[np.exp(rng.normal(5.25, 0.3, 600)).astype(int), rng.integers(295, 306, 300)]
    rep = np.r_[np.where(rng.random(600) < 0.5, 0, np.exp(rng.normal(3.0, 0.5, 600))), n[600:] * rng.normal(0.6, 0.01, 300)].astype(int)
    exc = (rep * 0.55).astype(int)
    cells = np.stack([*(np.where(rep > 0, R._grid(R._logit(x, n)), R.NOTHING) for x in (rep, exc)), R._grid(np.log(n + 1.0))], 1)
    mean, cov = R.estimate(*R.weighted(cells.astype(float), np.ones(900)))
    far = R._distances(np.stack([R._logit(rep, n), R._logit(exc, n), np.log(n + 1.0)], 1), mean, cov) > R.CHI2_999_3
    assert far[600:].all() and far[:600][rep[:600] > 0].mean() < 0.05


def titled(i):
    """A page with its title twice and a refrain: repetition that is usual, however large its share of a short page."""
    rng = random.Random(i)
    title, refrain, n = text(9000 + i, rng.randrange(8, 15)), text(8000 + i, rng.randrange(7, 14)), rng.choice([50, 70, 100, 150, 220, 300])
    return "\n".join([title, title, text(7000 + i, n), refrain, text(6000 + i, n // 5), refrain, *[refrain] * rng.randrange(2)])


def test_the_estimate_decides_what_the_share_alone_would_not(spark):
    usual = [(i, f"https://a.example/{i}", "hau_Latn", titled(i)) for i in range(300)]
    bad = [(1000 + i, f"https://{'ab'[i % 2]}.example/{i}", "hau_Latn", "\n".join([text(5000 + i, 60)] * 2 + [text(4000 + i, 90)])) for i in range(20)]
    df = pages(spark, usual + bad)
    by_share = {r["page_id"] for r in R.repetition_statistics(df).where("repeated >= 0.4 * words").collect()}
    found = {r["page_id"] for r in R.repetitive_pages(df).collect()}
    kept = found - {r[0] for r in bad}
    assert {r[0] for r in bad} <= found < by_share and len(kept) < len(by_share - found)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "2024-01-01 00:00:00") for r in rows], "doc_id string, annotator string, label int, status string, t string").selectExpr("*", "cast(t as timestamp_ntz) as labelled_at", "1 as agreement")


def test_consensus_overrules_unreliable_annotators(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(150):
        truth[f"d{i}"] = k = rng.choice([1, 1, 2, 3, 4])
        rows += [(f"d{i}", a, k if rng.random() < 0.85 else rng.randrange(1, 5), "done") for a in ("a", "B ", "c")]
        rows += [(f"d{i}", "flip", 5 - k, "done"), (f"d{i}", "ones", 1, "done"), (f"d{i}", "noise", rng.randrange(1, 5), "done")]
    rows += [("d0", "a", 9, "done"), ("d0", None, 1, "done"), (None, "a", 1, "done"), ("v", "a", 1, " VOID"), *rows[:3]]
    documents, annotators = C.consensus(labels(spark, rows))
    got = {r["doc_id"]: r["label"] for r in documents.collect()}
    assert sum(got[d] == k for d, k in truth.items()) >= 140 and "v" not in got
    reliable = {r["annotator"]: r["reliable"] for r in annotators.collect()}
    assert reliable == {"a": True, "b": True, "c": True, "flip": False, "ones": False, "noise": False}


def test_last_label_counts_and_alpha(spark):
    rows = spark.createDataFrame([("d", "a", 1, "done", "2024-01-02 00:00:00"), ("d", "A", 2, "done", "2024-01-01 00:00:00"), ("d", "b", 1, None, None)], "doc_id string, annotator string, label int, status string, t string").selectExpr("*", "cast(t as timestamp_ntz) as labelled_at")
    assert {(r["annotator"], r["label"]) for r in C.valid_votes(rows).collect()} == {("a", 1), ("b", 1)}
    r = C.alpha(labels(spark, [("x", "a", 1, "done"), ("x", "b", 1, "done"), ("y", "a", 2, "done"), ("y", "b", 2, "done"), ("z", "a", 1, "done")])).first()
    assert (r["documents"], r["votes"], r["alpha"]) == (2, 4, 1.0)


def test_consensus_of_nothing(spark):
    documents, annotators = C.consensus(labels(spark, []))
    assert documents.count() == 0 and annotators.count() == 0
    assert C.alpha(labels(spark, [])).first()["alpha"] is None
