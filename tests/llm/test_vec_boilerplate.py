import random
import unicodedata

import numpy as np
import pytest

from weftline.llm import boilerplate as B
from weftline.llm import vec


def test_line_keys_ignore_form_case_space_and_digits():
    _, keys, _ = vec.line_hashes(["Ọ̀rọ̀ 12 wa!\n" + unicodedata.normalize("NFD", "ọ̀rọ̀wa") + "\nọrọ wa\n12 – 3\n"])
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4] == 0


def test_words_fold_and_drop_signs():
    w = vec.Words(vec.Flat(["Àjọ ná'à – 12", None, "AJO naa 12", "ɗa"]))
    assert w.offsets.tolist() == [0, 3, 3, 6, 7]
    assert w.hash[:3].tolist() == w.hash[3:6].tolist()


def test_chunks_cover_all():
    texts = ["a" * n for n in (5, 0, 300, 7, 2)] + [None]
    ranges = list(vec.chunks(texts, 10))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(6))


@pytest.mark.parametrize("seed", range(6))
def test_container_round_trip(seed):
    rng = random.Random(seed)
    numbers = {0: [3], 1: range(5000), 2: rng.sample(range(65536), 9000), 3: rng.sample(range(65536), 50), 4: range(0, 65536), 5: [*range(10), *range(500, 40000)]}[seed]
    lows = np.array(sorted(numbers))
    kind, data = B.encode(lows)
    assert np.array_equal(B.decode(kind, data), lows) and len(data) <= 8192
    assert kind == {0: B.ARRAY, 1: B.RUNS, 2: B.BITMAP, 3: B.ARRAY, 4: B.RUNS, 5: B.RUNS}[seed]


ROWS = (
    [(i, f"https://www.A.example/p{i}?x={i}", f"Take {i}\nRaba wannan  labari!\nabu {i} kadan") for i in range(5)]
    + [(50, "http://a.example:80/p1/", "RABA WANNAN LABARI 12\nsabo")]  # a re-crawl of p1
    + [(60 + i, f"https://b.example/{i}", "Menu") for i in range(4)] + [(64, "https://b.example/0/", "Menu"), (70, None, "Raba wannan labari"), (71, "/rel", "Menu"), (72, "https://a.example/e", ""), (73, "https://a.example/n", None)]
)


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, wet_text string, host string")


def test_repeated_lines(spark):
    got = {(r["page_id"], r["line_no"]) for r in B.repeated_lines(frame(spark, ROWS + ROWS[:2])).collect()}
    # lines that differ in digits only are one line, so "Take 0" and "abu 0 kadan" repeat as well
    assert got == {(i, k) for i in range(5) for k in range(3)} | {(50, 0)}


def test_clean_and_report(spark):
    clean = {r["page_id"]: r for r in B.without_repeated_lines(frame(spark)).collect()}
    assert clean[50]["clean_text"] == "sabo" and clean[50]["removed"] == 1
    assert clean[60]["clean_text"] == "Menu" and clean[73]["clean_text"] is None and clean[70]["removed"] == 0
    assert {(r["host_name"], r["pages"]) for r in B.line_report(frame(spark)).collect()} == {("a.example", 5)}


def python_lines(rows, least):
    def key(line):
        low = unicodedata.normalize("NFC", unicodedata.normalize("NFD", line).lower())
        return "".join(c for c in low if unicodedata.category(c)[0] in "LM") if any(c.isalpha() for c in low) else ""

    on, out = {}, set()
    for page, url, text in rows:
        host, path = url.split("/")[2], url.split("/", 3)[3]
        for line in (text or "").split("\n"):
            if key(line):
                on.setdefault((host, key(line)), set()).add(path)
    for page, url, text in rows:
        out |= {(page, i) for i, line in enumerate((text or "").split("\n")) if key(line) and len(on[url.split("/")[2], key(line)]) >= least}
    return out


@pytest.mark.parametrize("chunk, part, most", [(65536, 1 << 14, 400_000), (4, 1 << 14, 400_000), (65536, 7, 400_000), (3, 5, 25), (65536, 1 << 14, 10)])
def test_any_division_of_hosts_gives_the_same_lines(spark, monkeypatch, chunk, part, most):
    monkeypatch.setattr(B, "CHUNK", chunk)  # containers per line, parts of a host, and a buffer that parts don't fit
    monkeypatch.setattr(B, "MOST_LINES", most)
    rng = random.Random(chunk + part + most)
    words = ["labari", "Wasanni", "ọ̀rọ̀", "siyasa", "LABARI!", "12", "ọrọ"]
    rows = [(i, f"https://h{rng.randrange(4) if i % 3 else 0}.example/p{rng.randrange(60)}", "\n".join(rng.choice(words) + " " + rng.choice(["abu", "", f"{rng.choice('abcdefghij')}"]) for _ in range(rng.randrange(9)))) for i in range(300)]
    rows += rows[:20] + [(1000 + i, "https://h0.example/same", f"labari abu\nsake {'abcdefgh'[i % 8]}") for i in range(150)]
    assert {(r["page_id"], r["line_no"]) for r in B.repeated_lines(frame(spark, rows), 5, part=part).collect()} == python_lines(rows, 5)


@pytest.mark.parametrize("forms", [("array", "runs"), ("bitmap", "array"), ("runs", "bitmap"), ("array", "array")])
def test_unions_of_containers(forms):
    sets = {"array": [1, 5, 70, 4000], "runs": list(range(100, 3000)), "bitmap": list(range(0, 40000, 3))}
    parts = [np.array(sets[f]) for f in forms]
    assert B.united([B.encode(p) for p in parts]).tolist() == sorted(set(parts[0]) | set(parts[1]))


def test_spellings_are_counted_over_all_containers(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 2)
    rows = [(i, f"https://c.example/{i}", f"{('Labari', 'LABARI!', 'labari 1')[i % 3]}\n{'abcd'[i % 4] * 3}") for i in range(12)]
    (report,) = (r for r in B.line_report(frame(spark, rows), 5).collect())
    assert (report["pages"], report["variants"]) == (12, 3)


def test_a_line_is_spelled_alike_at_the_end_of_the_texts():
    _, _, raws = vec.line_hashes(["Menu\nHome", "Home", "Menu"])
    assert raws[0] == raws[3] != raws[1] == raws[2]


def test_empty_table(spark):
    assert B.repeated_lines(frame(spark, [])).count() == 0 and B.line_report(frame(spark, [])).count() == 0
