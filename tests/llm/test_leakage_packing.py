import random

import pytest

from weftline.llm import leakage as K
from weftline.llm import packing as P


def words(seed, n):
    rng = random.Random(seed)
    return [f"kalma{rng.randrange(3000)}" for _ in range(n)]


HELD = [(1, " ".join(words(1, 40))), (2, "gajeriyar jumla ce ta jarrabawa kawai"), (3, None), (4, "– !"), (5, " ".join(words(1, 40)))]


def docs():
    a = words(1, 40)
    sub = a[:20] + ["dabam"] + a[21:]
    return [
        (1, "fara " + " ".join(a[3:16]).upper() + " karshe"), (2, " ".join(a[3:15])), (3, "Gàjeriyar, JUMLA ce\nta – jarrabawa. kawai!"), (4, "gajeriyar jumla ce ta"), (5, " ".join(sub[8:30])),
        (6, None), (7, ""), (8, " ".join(words(9, 3000) + a + words(8, 3000))), (8, " ".join(words(9, 3000) + a + words(8, 3000))),
    ]


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_leaks_by_both_ways(spark, most):
    d = spark.createDataFrame([(*r, 0) for r in docs()], "doc_id long, text string, item_id int")
    found = K.leaked_passages(d, spark.createDataFrame(HELD, "item_id long, text string"), most_indexed=most)
    rows = {(r["doc_id"], r["item_id"]): (r["exact_run"], r["overlap"]) for r in found.collect()}
    assert rows[5, 1] == (12, 22) and rows[1, 1] == (13, 13) and rows[8, 5] == (40, 40)
    assert {(r["doc_id"], r["item_id"]) for r in K.leaks(found).collect()} == {(1, 1), (1, 5), (3, 2), (8, 1), (8, 5)}


def test_empty_sides(spark):
    d, h = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(HELD, "item_id long, text string")
    assert K.leaked_passages(d, h).count() == 0
    assert K.leaked_passages(spark.createDataFrame(docs(), d.schema), h.where("false")).count() == 0


def test_masks_tolerate_any_inner_substitution():
    for span in range(3, 14):
        kept = [set(K.mask(span, s).tolist()) for s in range(3)]
        assert all(any(p not in m for m in kept) for p in range(1, span - 1))


@pytest.mark.parametrize("seed, most", [(1, 4), (2, 64), (3, 1)])
def test_packer_keeps_everything_whole(seed, most):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 40, 100, 101, 250, 0]) for _ in range(500)]
    packer = P.Packer(100, most)
    bins = [b for i, n in enumerate(sizes) for b in packer.add(i, list(range(n)))] + list(packer.finish())
    assert all(0 < sum(len(t) for _, _, t in b) <= 100 for b in bins)
    pieces = {}
    for b in bins:
        for key, at, tokens in b:
            pieces.setdefault(key, []).append((at, tokens))
    for i, n in enumerate(sizes):
        parts = sorted(pieces.get(i, []))
        assert [t for _, p in parts for t in p] == list(range(n)) and (n <= 100) == (len(parts) <= 1)


def test_fullest_bin_closes_first():
    packer = P.Packer(10, 2)
    assert list(packer.add("a", [0] * 6)) == [] and list(packer.add("b", [0] * 7)) == []
    assert [[k for k, _, _ in b] for b in packer.add("c", [0] * 5)] == [["b"]]


def test_sequences_hold_the_texts_tokens(spark):
    import os

    if not os.path.exists(P.TOKENIZER):
        pytest.skip("no tokenizer")
    texts = [(i, " ".join(words(i, 30 * i % 900))) for i in range(60)] + [(60, None), (61, ""), (62, "a " * 5000), (63, "gida"), (63, "gida")]
    packed = P.packed_sequences(spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, seq_id int"))
    got = {}
    for r in packed.collect():
        at = 0
        assert r["n_tokens"] + r["padding"] == 1024 and len(r["tokens"]) == r["n_tokens"]
        for k, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            got.setdefault(k, []).append((s, r["tokens"][at : at + n]))
            at += n
    enc = P.tokenizer(P.TOKENIZER)
    for k, t in texts[:60] + texts[62:63]:
        assert enc.decode([x for _, p in sorted(got.get(k, [])) for x in p]) == t
    assert len(got[63]) == 2 and 60 not in got
    assert P.packing_report(packed).first()["sequences"] == packed.count()
    assert P.packing_report(P.packed_sequences(spark.createDataFrame([], "doc_id long, text string"))).first()["padding_share"] == 0
