"""Near-duplicates, components, sampling, labels and reports against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import decontam, labels, minhash, reports, sampling
from weftline.operators.components import components


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(30)} == {100}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(seed, n=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_minhash_cases(spark):
    base, other = words(1), words(2)
    near = base[:200] + ["dabam"] + base[201:]
    half = base[:200] + other[200:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper()), (4, " ".join(other)), (5, " ".join(half)), (6, ""), (7, None)]
    c = {r["doc_id"]: r["cluster"] for r in minhash.duplicate_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert c[1] == c[2] == c[3] == 1 and c[4] == 4 and c[5] == 5 and c[6] == c[7] == 6


def test_signatures_equal_their_definition():
    import hashlib
    import unicodedata

    texts = [" ".join(f"x{i}" for i in range(9000)), "", None, "Uku kawai ne", unicodedata.normalize("NFD", "Ọ̀rọ̀ wa ni èyí, ọ̀rọ̀ wa ni èyí!"), " ".join(words(5, 50))]
    got = minhash.signatures(texts)
    for text, sig in zip(texts, got):
        toks = minhash.TOKENS.findall(unicodedata.normalize("NFC", text or "").lower())
        grams = {" ".join(toks[i : i + 5]) for i in range(max(1, len(toks) - 4))}
        least = [min((int(hashlib.md5(g.encode()).hexdigest()[:15], 16) * int(a) + int(b)) % 2**64 % minhash.MODULUS for g in grams) for a, b in zip(minhash.A[:6], minhash.B[:6])]
        assert sig[:6].tolist() == least


def test_fixed_coefficients():
    assert int(minhash.A[0]) == 1594034539292108678 and int(minhash.B[0]) == 1066941601240034990


def test_decontamination(spark):
    held = spark.createDataFrame([("s", " ".join(words(3, 30))), ("t", "gajere ne")], "set_name string, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words(3, 30)[5:18])), (2, " ".join(words(3, 30)[5:17])), (3, "gajere ne"), (4, None)], "doc_id long, text string")
    assert [r[0] for r in decontam.contaminated(docs, held).collect()] == [1]
    assert [tuple(r) for r in decontam.contamination_by_set(docs, held).collect()] == [(1, "s")]


def test_decontamination_by_both_ways(spark):
    held = spark.createDataFrame([("s", " ".join(words(3, 30))), ("t", " ".join(words(4, 20)))], "set_name string, text string")
    docs = spark.createDataFrame([(i, " ".join(words(i, 8) + words(3 + i % 3, 20)[:14])) for i in range(30)], "doc_id long, text string")
    for most in (0, 1_000_000):
        assert sorted(r[0] for r in decontam.contaminated(docs, held, most_sent=most).collect()) == [i for i in range(30) if i % 3 < 2]
        assert len(decontam.contamination_by_set(docs, held, most_sent=most).collect()) == 20


def test_running_sums_over_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, 1, 5, 9])) for i in range(400)]
    got = sampling.running_sum(spark.createDataFrame(rows, "i int, g string, k int, n int"), ["g"], [F.desc("k"), F.col("i")], "n")
    sums, want = {}, {}
    for i, g, _, n in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[i] = sums[g] = sums.get(g, 0) + (n or 0)
    assert {r["i"]: r["running"] for r in got.collect()} == want


def test_quota_budgets_and_batches(spark):
    docs = spark.createDataFrame([(i, f"v{i % 2}", "x" if i < 6 else "y", 10 + i) for i in range(12)], "i int, v string, g string, n int")
    assert {r["g"]: r["budget"] for r in sampling.language_quota(docs, "v", "g", "n").collect()} == {"x": 36, "y": 54}
    assert {(r["v"], r["budget"]) for r in sampling.global_budget(docs, "v", "n").collect()} == {("v0", 90), ("v1", 90)}
    assert {r["budget"] for r in sampling.global_budget(docs, "v", "n", 7).collect()} == {7}
    batches = sampling.length_batches(docs, "i", "n", 5).collect()
    assert sorted((r["batch"], r["id"]) for r in batches) == [((11 - i) // 5, i) for i in sorted(range(12), key=lambda i: ((11 - i) // 5, i))]


def test_a_fill_of_many_rounds(spark):
    rows = [(i, "g", 1000 - i) for i in range(130)]  # every item overflows after the first few
    docs = spark.createDataFrame(rows, "i long, g string, n long")
    order = {r["i"]: r["o"] for r in docs.withColumn("o", F.md5(F.concat_ws(":", F.lit("0"), F.col("i").cast("string")))).collect()}
    got = {r["i"] for r in sampling.greedy_fill(docs, spark.createDataFrame([("g", 2500)], "g string, budget long"), "i", "n", "g", 0, most_walked=3).collect()}
    assert got == python_fill(sorted(((i, n) for i, _, n in rows), key=lambda x: (order[x[0]], x[0])), 2500)


def python_fill(rows, budget):
    left, out = budget, []
    for i, n in rows:
        if n <= left:
            out.append(i)
            left -= n
    return set(out)


@pytest.mark.parametrize("walk", [0, 1_000_000])
def test_greedy_fill_equals_a_loop(spark, walk):
    rng = random.Random(5)
    rows = [(i, "a" if i % 3 else "b", rng.randrange(1, 60)) for i in range(200)]
    docs = spark.createDataFrame(rows, "i long, g string, n long").withColumn("o", F.md5(F.concat_ws(":", F.lit("0"), F.col("i").cast("string"))))
    order = {r["i"]: r["o"] for r in docs.collect()}
    budgets = spark.createDataFrame([("a", 700), ("b", 300)], "g string, budget long")
    got = {r["i"] for r in sampling.greedy_fill(docs, budgets, "i", "n", "g", 0, most_walked=walk).collect()}
    want = set()
    for g, b in (("a", 700), ("b", 300)):
        want |= python_fill(sorted(((i, n) for i, h, n in rows if h == g), key=lambda x: (order[x[0]], x[0])), b)
    assert got == want


@pytest.mark.parametrize("walk", [0, 1_000_000])
def test_site_cap_invariants(spark, walk):
    rows = [(i, "x", "big" if i < 60 else f"s{i % 7}", 10) for i in range(120)] + [(1000, "y", None, 5)]
    docs = spark.createDataFrame(rows, "i long, g string, s string, n long")
    kept = sampling.site_cap(docs, 0.2, "i", "n", "g", "s", most_walked=walk).join(docs, ["g", "i"]).where("g = 'x'").groupBy("s").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in kept)
    assert all(r["n"] <= 0.2 * total + 1e-9 for r in kept) and total == 750


def test_budget_prefix_stops_at_first_overflow(spark):
    docs = spark.createDataFrame([(i, "g", 10) for i in range(20)], "i long, g string, n long")
    assert sampling.budget_prefix(docs, 55, "i", "n", ["g"]).count() == 5


def test_label_sets(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows = [
        ("u", "a", "done", 1, "h", "https://one.example/u", 1), ("u", "b", "done", 1, "h", "https://one.example/u", 1), ("t", "a", "done", 1, "h", "https://two.example/t", 1), ("t", "b", "done", 3, "h", "https://two.example/t", 1),
        ("v", "a", "VOID ", 1, "h", "https://three.example/v", 1), ("s", "a", "done", 1, "h", "https://four.example/s", 1), ("x", "a", "done", 2, "h", "https://one.example/x", 0), ("y", "a", "done", 1, "h", "https://five.example/y", 0), (None, "a", "done", 1, "h", None, 0),
    ]
    df = spark.createDataFrame([(*r, at) for r in rows], "doc_id string, annotator string, status string, label int, lang string, url string, shared int, labelled_at timestamp_ntz")
    voted = labels.votes(df)
    test = labels.test_set(voted)
    assert {(r["doc_id"], r["keep"]) for r in test.collect()} == {("u", 1)}
    assert {(r["doc_id"], r["keep"]) for r in labels.train_set(voted, test).collect()} == {("y", 1)}


def test_classifier_learns_held_out(spark):
    rng = random.Random(2)
    make = lambda good: " ".join(rng.choice(["gari", "ruwa", "labari", "mutane"] if good else ["saya", "danna", "kyauta", "rangwame"]) for _ in range(20))
    train = spark.createDataFrame([(make(i % 2), i % 2) for i in range(200)], "text string, keep int")
    docs = spark.createDataFrame([(str(i), make(i % 2)) for i in range(60)] + [("null", None)], "id string, text string")
    p = {r["id"]: r["p"] for r in labels.keep_probability(train, docs).collect()}
    assert sum((p[str(i)] > 0.5) == bool(i % 2) for i in range(60)) >= 57 and "null" in p


def test_scores_metrics_and_comparison(spark):
    a = spark.createDataFrame([("x", 0.1), ("y", 0.2)], "id string, p double")
    b = spark.createDataFrame([("x", 0.9)], "id string, p double")
    assert {r["id"]: r["p"] for r in labels.latest_scores(a, b).collect()} == {"x": 0.9, "y": 0.2}
    m = {r["lang"]: r for r in labels.metrics(spark.createDataFrame([("h", 0.9, 1), ("h", 0.5, 1), (None, 0.8, 0)], "lang string, p double, keep int")).collect()}
    assert m["h"]["recall"] == 0.5 and m["all"]["precision"] == 0.5 and m[""]["recall"] == 0.0
    curves = spark.createDataFrame([("a", "s", 1.0), ("a", "s", 1.1), ("b", "s", 1.2), ("b", "t", 1.0), ("a", "t", 1.0)], "version string, held_set string, bpb double")
    r = reports.compare_versions(curves).first()
    assert (r["wins"], r["losses"], r["unclear"]) == (1, 0, 1)


def test_mean_over_seeds_does_not_depend_on_the_rows_order(spark):
    seeds = {"a": [1.2834, 1.2936, 1.2769, 1.2835], "b": [1.2955, 1.3095, 1.317, 1.2954], "c": [1.2, 1.3, 1.3]}  # a and b: halves
    rows = [(name, str(i), x) for name, xs in seeds.items() for i, order in enumerate(itertools.permutations(xs)) for x in order]
    rows += [("nan", "0", 1.0), ("nan", "0", float("nan")), ("none", "0", None), ("some", "0", None), ("some", "0", 1e300)]
    got = {(r.version, r.held_set): r for r in reports.seed_ranges(spark.createDataFrame(rows, "version string, held_set string, bpb double").coalesce(1)).collect()}
    assert {(v, got[v, s].mean) for v, s in got if v in seeds} == {("a", 1.2844), ("b", 1.3044), ("c", 1.2667)}
    assert math.isnan(got["nan", "0"].mean) and got["none", "0"].mean is None and got["some", "0"].mean == 1e300


def test_a_missing_score_is_an_error_unless_it_may_lack(spark):
    docs = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "id string, optional boolean")
    scores = spark.createDataFrame([("a", 0.2), ("c", 0.7)], "id string, p double")
    assert {(r["id"], r["p"]) for r in labels.join_scores(docs, scores, optional="optional").collect()} == {("a", 0.2), ("c", 0.7)}
    with pytest.raises(Exception, match="no score for b"):
        labels.join_scores(docs.drop("optional"), scores).collect()


def test_release_rows_must_match_their_shard(spark):
    docs = spark.createDataFrame([("s:1", "u", "t", "cc"), ("h:1", "v", None, "recrawl"), ("f:9", None, "w", "fw2"), ("f:8", None, "w", "fw2")], "id string, url string, text string, source string")
    shards = spark.createDataFrame([("s:1", "u", "t", "crawl-data/CC-MAIN-2024-10/x", 0.9)], "id string, url string, text string, wet_file string, lid_prob double")
    again = spark.createDataFrame([("h:1", 0.8, "2024-01-01T00:00:00Z")], "id string, lid_prob double, fetched string")
    fold = spark.createDataFrame([("9", 0.5)], "id string, language_score double")
    rows = {r["id"]: r for r in labels.release_rows(docs, shards, again, fold).collect()}
    assert (rows["s:1"]["snapshot"], rows["s:1"]["lid_score"], rows["h:1"]["fetched"], rows["f:9"]["lid_score"], rows["f:8"]["lid_score"]) == ("CC-MAIN-2024-10", 0.9, "2024-01-01T00:00:00Z", 0.5, None)
    with pytest.raises(Exception, match="does not match its shard"):
        labels.release_rows(docs, shards.withColumn("text", F.lit("x")), again, fold).collect()


def test_identifiers_and_confusion(spark):
    from weftline.operators import lid

    docs = spark.createDataFrame([(1, "da ne da\nwani"), (2, None), (3, "the a")], "id int, t string")
    stops = spark.createDataFrame([("hau", "Da"), ("hau", "ne"), ("eng", "the"), ("fra", "a")], "lang string, word string")
    assert {(r["id"], r["label"], r["prob"]) for r in lid.by_common_words(docs, stops, "id", "t").collect()} == {(1, "hau", 1.0), (2, None, 0.0), (3, "eng", 0.5)}
    ours = lid.by_model(docs, lambda: lambda texts: (["x" if "\n" in t else "one" for t in texts], [0.5] * len(texts)), "id", "t")
    assert {r["label"] for r in ours.collect()} == {"one"}
    rows = spark.createDataFrame([("hau_Latn", "hau"), ("hau_Latn", "yor"), (None, "yor"), ("ibo", None)], "a string, b string")
    assert {tuple(r) for r in lid.confusion(rows, "a", "b").collect()} == {("hau_Latn", "yor", 1), ("", "yor", 1), ("ibo", "", 1)}


def test_scored_bytes_need_whole_pieces(spark):
    df = spark.createDataFrame([("ab é cd", ["ab", " é", " cd"])], "t string, p array<string>")
    assert df.select(reports.scored_bytes(F.col("p"), F.col("t"), 2)).first()[0] == 3
    with pytest.raises(Exception, match="add up"):
        df.select(reports.scored_bytes(F.slice("p", 1, 2), F.col("t"), 2)).collect()
    assert reports.checkpoints(20) == [0, 2, 3, 4, 6, 8, 11, 16, 20]


def test_token_counts_are_the_round_trips(spark):
    import os

    from weftline.functions import bpe

    if not os.path.exists(bpe.TOKENIZER):
        pytest.skip("no tokenizer")
    texts = ["Ina kwana, lafiya?", "", None, "ọ̀rọ̀ wa\n 12"]
    got = {r["t"]: r["n"] for r in bpe.with_token_count(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    enc = bpe.tokenizer(bpe.TOKENIZER)
    assert got == {t: len(enc.encode_ordinary(t or "")) + 1 for t in texts} and enc.decode(enc.encode_ordinary(texts[3])) == texts[3]
