"""Readers, sinks and streams on small files."""

import gzip
import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.sources import readers, release
from weftline.streaming import ingest

PAGES = [{"url": f"https://a.example/{i}", "lang": "hau_Latn" if i % 2 else "eng_Latn", "lid_prob": 0.9, "wet_text": "layi na biyu\u0085 uku", "wet_file": "f"} for i in range(6)]


def two_frames(path):
    c = zstandard.ZstdCompressor()
    lines = [json.dumps(p, ensure_ascii=False) for p in PAGES]
    path.write_bytes(c.compress(("\n".join(lines[:3]) + "\n\n").encode()) + c.compress(("\n".join(lines[3:]) + "\n").encode()))


def test_numbered_lines_over_frames(spark, tmp_path):
    two_frames(tmp_path / "s0.jsonl.zst")
    rows = readers.shard_lines(spark, str(tmp_path / "*.zst")).orderBy("line_no").collect()
    assert [r["id"] for r in rows] == [f"s0.jsonl.zst:{i}" for i in range(6)]
    assert json.loads(rows[5]["record"]) == PAGES[5]


def test_json_lines_keep_odd_line_ends(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in PAGES), encoding="utf-8")
    assert [r["wet_text"] for r in readers.json_lines(spark, str(tmp_path)).collect()] == [PAGES[0]["wet_text"]] * 6


def test_gzip_and_tsv(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(json.dumps({"text": "a\\nb", "url": None}) + "\n")
    assert readers.unescaped_json_lines(spark, str(tmp_path / "a.json.gz")).first()["text"] == "a\nb"
    (tmp_path / "h.tsv").write_text('a.example\tdrop\n"b".example\tkeep\n')
    assert readers.tsv(spark, str(tmp_path / "h.tsv"), "host string, decision string").count() == 2


def record(kind, url, text):
    body = text.encode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_wet_source(spark, tmp_path):
    long = "labari " * 5000
    data = record("warcinfo", "x", "y" * 300) + record("conversion", "https://a.example/1", long) + record("conversion", "https://a.example/2", "gajere")
    (tmp_path / "a.wet.gz").write_bytes(gzip.compress(data[:500]) + gzip.compress(data[500:]))
    spark.dataSource.register(readers.WetSource)
    rows = spark.read.format("wet").option("paths", str(tmp_path / "a.wet.gz")).load().collect()
    assert [(r["url"], len(r["wet_text"])) for r in rows] == [("https://a.example/1", 20000)]


@pytest.mark.parametrize("html, text", [("<p>Ina <b>kwana</b></p><nav>x</nav><script>1</script><p>A&amp;B", "Ina kwana\nA&B"), ("", ""), (None, None), ("<table><tr><td>1</table>babu", "babu")])
def test_html_text(html, text):
    assert readers.main_text(html) == text


def test_html_links_and_charset(spark):
    latin = bytearray("é".encode("latin-1"))
    rows = [("<a href='/x'>1</a> <A class=y href=\"z\"><link type='application/rss+xml' rel=x href='/f'><link href='/g' type='application/atom+xml'><link href='/i'>", "<loc> <![CDATA[https://a.example/1]]> </loc>", latin, None), ("", "", bytearray("é".encode()), "text/html"), ("", "", latin, "text/html; charset=latin-1"), ("", "", bytearray("é".encode()), "text/html; charset=latin-1"), ("", "", latin, "text/html; charset=none-such"), ("", "", None, None)]
    df = spark.createDataFrame(rows, "h string, s string, b binary, c string")
    out = df.select(readers.anchors(F.col("h")).alias("a"), readers.feed_links(F.col("h")).alias("f"), readers.sitemap_urls(F.col("s")).alias("s"), readers.decoded_html("b", "c").alias("t")).collect()
    assert out[0]["a"] == ["/x", "z"] and out[0]["f"] == ["/f", "/g"] and out[0]["s"] == ["https://a.example/1"]
    assert [r["t"] for r in out] == ["é", "é", "é", "Ã©", "é", None]


@pytest.mark.parametrize("log, state", [("a\n  robots_ok 1\n", "fetched"), ("3 sitemap lines in robots.txt", "fetched"), ("0 sitemap lines in robots.txt", "not recorded"), ("robots_404_allow_all_per_rfc9309 2", "absent_4xx"), ("robots_503_assumed_open", "unreachable_assumed_open"), ("ok robots_ok", "not recorded"), (None, "not recorded")])
def test_robots_by_log(spark, log, state):
    assert spark.createDataFrame([(log,)], "l string").select(readers.robots_state(F.col("l"))).first()[0] == state


def test_shards_lists_and_resume(spark, tmp_path):
    path = str(tmp_path / "s")
    docs = spark.createDataFrame([(i, f"t{i}\u2028", None, i % 3) for i in range(30)], "id int, content string, url string, shard int")
    release.write_shards(docs, path, "shard", "id")
    before = {f.name: f.read_bytes() for f in (tmp_path / "s").iterdir()}
    release.write_shards(docs.where("id > 5"), path, "shard", "id")  # files that are there are left
    assert before == {f.name: f.read_bytes() for f in (tmp_path / "s").iterdir()} and len(before) == 3
    (tmp_path / "s" / "9.jsonl.zst").write_bytes(b"")
    names = readers.frozen_list(spark, f"{path}/*.zst", str(tmp_path / "list"), 20)
    (tmp_path / "s" / "late.jsonl.zst").write_bytes(before["0.jsonl.zst"])
    assert readers.listed(spark, readers.frozen_list(spark, f"{path}/*.zst", names, 20), path) == [f"{path}/{i}.jsonl.zst" for i in range(3)]
    assert readers.listed(spark, names, path, 1, 2) == [f"{path}/1.jsonl.zst"]
    rows = readers.plain_json_lines(spark, f"{path}/0.jsonl.zst", "x").orderBy("text").collect()
    assert {(r["id"], r["text"]) for r in rows} == {(f"x:0:{i}", f"t{3 * i}\u2028") for i in range(10)}
    parts = release.fixed_parts(docs, 4, "id").groupBy("part").agg(F.min("line_no").alias("a"), F.max("line_no").alias("z"), F.count("*").alias("n")).collect()
    assert all(r["a"] == 0 and r["z"] == r["n"] - 1 for r in parts) and sum(r["n"] for r in parts) == 30


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    from weftline import session

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Cluster)


def test_release_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i:03}", "hau_Latn" if i % 2 else "yor_Latn", f"t{i}", "cc") for i in range(50)], "id string, lang string, text string, source string")
    path = release.write_release(docs, str(tmp_path / "r"), rows_per_file=10)
    said = release.manifest(spark, path)
    assert said["languages"]["hau_Latn"]["docs"] == 25 and release.verified(spark, path)
    assert spark.read.parquet(f"{path}/data").columns == [*release.RELEASE_COLUMNS, "lang"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        release.write_release(docs, path)
    spark.read.parquet(f"{path}/data").limit(3).coalesce(1).write.parquet(f"{path}/data/lang=extra")
    assert not release.verified(spark, path)
    release.write_json_lines(docs, str(tmp_path / "j"), ["lang"])
    assert spark.read.json(str(tmp_path / "j")).count() == 50


def test_token_store(spark):
    docs = spark.createDataFrame([(str(i), list(range(i))) for i in range(30)], "id string, tokens array<int>")
    seen = {}
    for r in release.token_store(docs, parts=4).collect():
        flat, at = np.frombuffer(r["store"], "<u2"), 0
        for i, end in zip(r["ids"], r["ends"]):
            seen[i] = flat[at:end].tolist()
            at = end
    assert seen == {str(i): list(range(i)) for i in range(30)}


def test_page_stream_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: ingest.ingest_pages(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (source / "a.json").write_text("\n".join(map(json.dumps, PAGES)))
    run()
    (source / "b.json").write_text("\n".join(map(json.dumps, PAGES)))
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 6 and {r["lang"] for r in rows.select("lang").distinct().collect()} == {"hau_Latn"}
