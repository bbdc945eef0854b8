"""Queries that go through sources and sinks: tables are written in a format, read back, and must come out the same."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import rules
from weftline.plans.base import DROPPED, DROPPED_SQL, parents_sql, pick, pick_sql, query, site_sql, strip_sql, tokens_sql
from weftline.plans.dedup_queries import docs_of
from weftline.session import shared_dir, table
from weftline.sources import readers, release


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select doc_id, md5(text) as digest, url from documents")
def scan_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON lines in zstd shards, and back."""
    path = folder(spark, "jsonl")
    release.write_shards(docs_of(spark, d).select("doc_id", "url", "text", (F.col("doc_id") % 8).alias("shard")), path, "shard", "doc_id")
    back = readers.json_lines(spark, path, "doc_id long, url string, text string")
    return back.select("doc_id", F.md5("text").alias("digest"), "url")


@query("select doc_id % 8 || '.jsonl.zst:' || (row_number() over (partition by doc_id % 8 order by doc_id) - 1) as id, doc_id, length(text) as n_chars from documents")
def scan_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Shards of a frozen list, and each record's id by its line."""
    path = folder(spark, "shards")
    release.write_shards(docs_of(spark, d).select("doc_id", "text", (F.col("doc_id") % 8).alias("shard")), path, "shard", "doc_id")
    names = readers.listed(spark, readers.frozen_list(spark, f"{path}/*.zst", f"{path}-list"), path)
    rows = readers.shard_lines(spark, names).withColumn("r", F.from_json("record", "doc_id long, text string"))
    return rows.select("id", "r.doc_id", F.length("r.text").cast("long").alias("n_chars"))


@query("select 'pool:' || coalesce(lang, 'none') || ':' || (row_number() over (partition by coalesce(lang, 'none') order by doc_id) - 1) as id, url, md5(text) as digest from documents")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    """Plain JSON lines without ids, one file a language: ids are made of the file and the line."""
    path = folder(spark, "plain")
    rows = docs_of(spark, d).select("doc_id", "url", F.col("text").alias("content"), F.coalesce("lang", F.lit("none")).alias("shard"))
    release.write_shards(rows, path, "shard", "doc_id", ".jsonl")
    return readers.plain_json_lines(spark, path, "pool").select("id", "url", F.md5("text").alias("digest"))


@query("select doc_id, length(text) as n_chars, sha256(text) as checksum from documents")
def unescape_newlines(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped JSON lines whose line ends are written as two characters."""
    path = folder(spark, "gz")
    escaped = docs_of(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("text"), (F.col("doc_id") % 5).alias("shard"))
    release.write_shards(escaped, path, "shard", "doc_id", ".jsonl.gz")
    back = readers.unescaped_json_lines(spark, path, schema="doc_id long, text string")
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("checksum"))


def _archive(rows: pa.Table) -> pa.Table:
    records = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
    for url, text in zip(rows.column("url").to_pylist(), rows.column("text").to_pylist()):
        body = text.encode()
        records.append(f"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    data = b"".join(gzip.compress(r) for r in records)  # a member for each record, as in crawls
    return pa.table({"name": [f"{rows.column('shard')[0].as_py()}.wet.gz"], "data": pa.array([data], pa.binary())})


@query("select 'https://a.example/' || doc_id as url, md5(substr(text, 1, 20000)) as digest from documents where length(text) >= 200")
def scan_archives(spark: SparkSession, d: str) -> DataFrame:
    """WET archives made of the documents, by the WET source: its least length and the format's greatest."""
    path = folder(spark, "wet")
    spark.dataSource.register(release.FilesSink)
    spark.dataSource.register(readers.WetSource)
    docs = docs_of(spark, d).where("text is not null").select(F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string")).alias("url"), "text", (F.col("doc_id") % 6).alias("shard"))
    docs.groupBy("shard").applyInArrow(_archive, "name string, data binary").write.format("files").option("path", path).mode("append").save()
    return spark.read.format("wet").option("paths", ",".join(f"{path}/{i}.wet.gz" for i in range(6))).load().select("url", F.md5("wet_text").alias("digest"))


@query("select nullif(lang, '') as lang, count(*) as docs, sum(length(text))::BIGINT as chars, true as verified from (select distinct id, lang, text from build_a) group by 1")
def release_files(spark: SparkSession, d: str) -> DataFrame:
    """The pool as a release with its manifest: counted again from the files, which must be the manifest's. Missing and blank labels are one folder."""
    path = folder(spark, "release")
    pool = table(spark, d, "build_a").select("id", "lang", "text").distinct()
    release.write_release(pool, path, rows_per_file=1000)
    release.manifest(spark, path)
    good = release.verified(spark, path)
    sums = spark.read.parquet(f"{path}/data").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    return sums.withColumn("verified", F.lit(good))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for store, ids, ends in zip(b.column("store").to_pylist(), b.column("ids").to_pylist(), b.column("ends").to_pylist()):
            sums = np.r_[0, np.cumsum(np.frombuffer(store, "<u2").astype(np.int64))]
            starts = [0, *ends[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([z - a for a, z in zip(starts, ends)]), pa.array([int(sums[z] - sums[a]) for a, z in zip(starts, ends)])], ["id", "n_tokens", "total"])


@query(f"with t as (select doc_id, list_transform({tokens_sql('text')}, lambda x: length(x)) as n from documents) select doc_id::VARCHAR as id, len(n) as n_tokens, coalesce(list_sum(n), 0)::BIGINT as total from t")
def token_store(spark: SparkSession, d: str) -> DataFrame:
    """Flat stores of 16-bit numbers in a random order, read back by their ends; words' lengths stand for token ids."""
    toks = T.tokens(T.nfc(F.coalesce("text", F.lit(""))))
    docs = docs_of(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.transform(toks, lambda x: F.length(x)).alias("tokens"))
    return release.token_store(docs, parts=8).mapInArrow(_unpacked, "id string, n_tokens long, total long")


@query("select part, count(*) as n, min(line_no)::INT as first, max(line_no)::INT as last from (select doc_id % 7 as part, row_number() over (partition by doc_id % 7 order by doc_id) - 1 as line_no from documents) group by 1")
def fixed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Dense line numbers in parts, as ids of the pool are made."""
    from weftline.operators.sampling import running_sum

    parted = docs_of(spark, d).select("doc_id", (F.col("doc_id") % 7).alias("part"), F.lit(1).alias("one"))
    numbered = running_sum(parted, ["part"], [F.col("doc_id")], "one", "place")
    return numbered.groupBy("part").agg(F.count("*").alias("n"), (F.min("place") - 1).cast("int").alias("first"), (F.max("place") - 1).cast("int").alias("last"))


# --- pages and their urls

HOSTS = ("ha.shop.com", "yo.legit.ng", "ig.jw.org", "www.tool.com", "news.bbc.com", "voahausa.com", "yor.bbc.co.uk", "ha.wikipedia.org")
FOLDERS = ("/yo/x", "/ha-ng/", "/hausa/", "/ig", "/wiki/Musamman:Kano", "/tag/a", "/IBO")
RULE_URL = f"'https://' || {pick_sql(HOSTS, 'page_id')} || {pick_sql(FOLDERS, 'page_id')}"
LOCAL_LIST = "(" + ", ".join(f"'{h}'" for h in rules.LOCAL_HOSTS) + ")"
URL_RULES = rf"""case when regexp_matches(h, '(^|\.)wikipedia\.org$') and regexp_matches(p, '(?i)/wiki/musamman:') then 'wiki_infrastructure'
    when regexp_matches(h, '^(?:ha|ig|yo|hau|ibo|yor)\.') and not regexp_matches(h, '\.ng$|(^|\.)wikipedia\.org$') and regexp_replace(h, '^[^.]*\.', '') not in {LOCAL_LIST} then 'mt_localisation'
    when regexp_matches(p, '(?i)^/(?:ha|ig|yo|hau|ibo|yor)(?:[-_][a-z]{{2,4}})?(?:/|$)') and not regexp_matches(h, '\.ng$|(^|\.)wikipedia\.org$') and h <> 'tool.com'
        and not list_has_any(['{"', '".join(rules.LOCAL_HOSTS)}'], {parents_sql('h')}) then 'mt_path' end"""


def rule_url() -> Column:
    return F.concat(F.lit("https://"), pick(HOSTS, "page_id"), pick(FOLDERS, "page_id"))


def decisions(spark: SparkSession) -> DataFrame:
    """The host decision list, by the TSV source."""
    path = folder(spark, "hosts")
    spark.createDataFrame([("tool.com\tkeep\tseen",), ("shop.com\tdrop\t",), ("legit.ng\tdrop\t\"",)], "line string").coalesce(1).write.text(path)
    return readers.tsv(spark, path, "host string, decision string, note string")


@query(f"""with u as (select distinct page_id, wet_text, {site_sql(f'({RULE_URL})')} as h, regexp_extract({RULE_URL}, '^https://[^/]*(.*)$', 1) as p from apply_filters)
    select page_id, coalesce({URL_RULES}, case when coalesce(wet_text, '') = '' then 'gopher_quality:word_count' end) as reason from u""")
def cascade_urls(spark: SparkSession, d: str) -> DataFrame:
    """The cascade on urls that its url rules tell, with the kept hosts of the decision list; of the text rules only empty texts count here."""
    pages = table(spark, d, "apply_filters").select("page_id", rule_url().alias("url"), F.lit("hau_Latn").alias("lang"), F.when(F.col("wet_text") == "", F.lit("")).otherwise(F.when(F.col("wet_text").isNull(), F.lit("")).otherwise(F.lit(PLAIN))).alias("text"), F.md5("wet_text").alias("t")).distinct().drop("t")
    stops = spark.createDataFrame([], "lang string, stop array<string>")
    return rules.with_reason(pages, stops, decisions(spark)).select("page_id", "reason")


PLAIN = " ".join(f"kalma{chr(97 + i % 26)}{i} ne" for i in range(40))


@query(rf"""with u as (select page_id, {site_sql(f'({RULE_URL})')} as h, regexp_extract({RULE_URL}, '^https://[^/]*(.*)$', 1) as p from apply_filters),
    o as (select case when list_has_any({DROPPED_SQL}, {parents_sql('h')}) then 'blocked' else coalesce(nullif({URL_RULES}, 'mt_path'), 'ok') end as outcome from u)
    select outcome, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from o group by 1""")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Fetch outcomes of the urls with their share; the share's window runs over a few outcomes."""
    from pyspark.sql.window import Window

    url = rule_url()
    reason = F.coalesce(rules.url_reason(url, U.site(url), F.array(*map(F.lit, DROPPED))), F.lit("ok"))
    counts = table(spark, d, "apply_filters").groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


WORDS_SQL = "w as (select distinct name as w from name_list union select distinct word from stop_words)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "name_list").select(F.col("name").alias("w")).union(table(spark, d, "stop_words").select("word")).distinct()


@query(f"with {WORDS_SQL} select w, lower(w) || ' (' || lower(w) || ')' as page, lower(w) || ' 1+1' as param, null::VARCHAR as other from w")
def wiki_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles of encoded urls: by path, by parameter, and of a url that has neither."""
    url = lambda *parts: T.wiki_title(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    coded = F.url_encode("w")
    page = url("https://ha.wikipedia.org/wiki/", coded, "_%28", coded, ")?title=x#y")
    param = url("https://ha.wikipedia.org/w/index.php?subtitle=z&title=", coded, "_1%2B1&action=view")
    return _words(spark, d).select("w", page.alias("page"), param.alias("param"), url("https://ha.wikipedia.org/w/index.php?subtitle=", coded).alias("other"))


LINKS = (("/a/b?x=", "https://base.example/a/b?x="), ("c/d", "https://base.example/a/b/c/d"), ("../e", "https://base.example/a/e"), ("//host.example/f", "https://host.example/f"), ("mailto:x", None), ("./g/../h", "https://base.example/a/b/h"), ("?q=", "https://base.example/a/b/c?q="), ("ftp://x/", None))


@query(f"""select page_id, {pick_sql([a for a, _ in LINKS], 'page_id')} || page_id as link, {pick_sql([b for _, b in LINKS], 'page_id')} || page_id as target, case when url like 'http%' then regexp_replace(url, '#.*$', '') end as own,
    page_id % 8 in (1, 2, 5, 6) and false or page_id % 8 = 0 or coalesce({site_sql('url')} = 'base.example', false) as same from apply_filters""")
def link_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Links of every kind against a base, each page's own url, and whether a link stays on the base's host."""
    base, link = F.lit("https://base.example/a/b/c"), F.concat(pick([a for a, _ in LINKS], "page_id"), F.col("page_id").cast("string"))
    same = U.same_host(link, F.lit("base.example")) | F.coalesce(U.same_host(F.col("url"), F.lit("base.example")), F.lit(False))
    return table(spark, d, "apply_filters").select("page_id", link.alias("link"), T.link_target(link, base).alias("target"), T.link_target(F.col("url"), F.lit("https://base.example/")).alias("own"), same.alias("same"))


# --- fetched pages

@query(rf"""with l as (select doc_id, list_filter(list_transform(string_split_regex(text, '[\n\x{{2028}}\x{{2029}}\x{{85}}\x0b\x0c\r\x1c-\x1e]'), lambda x: trim(regexp_replace({strip_sql('x')}, '[\t ]+', ' ', 'g'))), lambda x: x <> '') as ls from documents where text is not null)
    select doc_id, md5('Take' || chr(10) || array_to_string(ls, chr(10))) as digest, len(ls) + 1 as n_lines from l""")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    """Main text of pages made of the documents' lines, with navigation, scripts, forms, tables and entities around and in them."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    blocks = F.transform(F.split(escaped, r"[\n\x{2028}\x{2029}\x{85}\x0b\x0c\r\x1c-\x1e]"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p><script>if (a < b) { c() }</script>")))
    page = F.concat(
        F.lit("<html><head><style>p {}</style></head><body><nav>Menu<a href='/'>Gida</a></nav><article><h1>Take</h1>"), F.array_join(blocks, "<table><tr><td>1</td></tr></table>"),
        F.lit("</article><form>Nema <button>x</button></form><footer>Karshe</footer></body></html>"),
    )
    text = readers.html_text(page)
    return docs_of(spark, d).where("text is not null").select("doc_id", text.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.size(F.split("t", "\n")).cast("long").alias("n_lines"))


@query("""with u as (select distinct page_id, url from apply_filters where url is not null), c as (select page_id, count(*) as n, min(url) as first, max(url) as last from u group by 1)
    select page_id, n + 1 as links, first, 'https://f.example/rss?' || page_id as feed, last as entry from c""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Anchors, feeds and sitemap entries of pages made of the tables' urls; other tags' addresses are none."""
    pages = table(spark, d, "apply_filters").where("url is not null").select("page_id", "url").distinct()
    key = F.col("page_id").cast("string")
    each = pages.groupBy("page_id").agg(
        F.concat(
            F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.lit("<A class='x' hreflang=ha HREF=\""), "url", F.lit('">x</a><img src="/y"><abbr href="/no">')))), F.lit("<a name=q href='/z'>")),
            F.lit("<link rel=alternate href='https://f.example/rss?"), F.first(key), F.lit("' type='application/rss+xml'><link rel=icon href='/i' type='image/png'>"),
            F.lit("<urlset><url><loc> <![CDATA["), F.max("url"), F.lit("]]></loc></url></urlset>"),
        ).alias("html")
    )
    anchors = readers.anchors(F.col("html"))
    return each.select("page_id", F.size(anchors).cast("long").alias("links"), F.array_min(F.filter(anchors, lambda x: x != "/z")).alias("first"), readers.feed_links(F.col("html"))[0].alias("feed"), readers.sitemap_urls(F.col("html"))[0].alias("entry"))


@query("select page_id, coalesce(wet_text, '') || 'é' as text, length(coalesce(wet_text, '')) + 1 as n_chars from apply_filters where page_id % 3 = 0 union all select page_id, 'é', 1 from apply_filters where page_id % 3 > 0")
def html_charset(spark: SparkSession, d: str) -> DataFrame:
    """Bytes as UTF-8 without a charset, in a declared charset, and as Latin-1 that declares none."""
    rows = table(spark, d, "apply_filters")
    third = F.col("page_id") % 3
    text = F.when(third == 0, F.concat(F.coalesce("wet_text", F.lit("")), F.lit("é"))).otherwise("é")
    content = F.when(third == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    kind = F.when(third == 1, "text/html; charset=ISO-8859-1").when(third == 2, "text/html")
    return rows.select("page_id", readers.decoded_html(content, kind).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


KINDS = ("text/html; charset=utf-8", "application/pdf", "", "application/xhtml+xml", "image/png")


@query(f"""select outcome, count(*) as n from (select case when {pick_sql(KINDS, 'page_id')} <> '' and not contains({pick_sql(KINDS, 'page_id')}, 'html') then 'not_html' when coalesce(length(wet_text), 0) < 200 then 'extract_too_short'
    when not coalesce(lang in ('hau_Latn', 'ibo_Latn', 'yor_Latn') and lid_prob >= 0.3, false) then 'lid_reject:' || coalesce(lang, '') else 'ok' end as outcome from apply_filters) group by 1""")
def fetch_gates(spark: SparkSession, d: str) -> DataFrame:
    """Why fetched pages are refused: content type, length, language."""
    why = rules.fetch_reason(pick(KINDS, "page_id"), F.col("wet_text"), F.col("lang"), F.col("lid_prob"))
    return table(spark, d, "apply_filters").groupBy(F.coalesce(why, F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


HOST_PAGES = f"h as (select {site_sql('url')} as host, count(*) as n from apply_filters where url is not null group by 1)"
STATE_SQL = "case when n % 5 = 0 then 'fetched' when n % 5 = 1 then 'absent_4xx' when n % 5 = 2 then 'unreachable_assumed_open' when n % 5 = 3 and n > 3 then 'fetched' else 'not recorded' end"


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """(host, state) by the crawler's logs, one text a host, made of its number of pages."""
    n = F.col("n")
    said = F.when(n % 5 == 0, "   robots_ok 1").when(n % 5 == 1, "robots_404_allow_all_per_rfc9309 1").when(n % 5 == 2, "  robots_503_assumed_open 2").when(n % 5 == 3, F.concat(F.when(n > 3, n.cast("string")).otherwise("0"), F.lit(" sitemap lines in robots.txt"))).otherwise("no robots_ok here")
    hosts = table(spark, d, "apply_filters").where("url is not null").groupBy(U.site(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return hosts.select("host", readers.robots_state(F.concat(F.lit("start\nok 12\n"), said, F.lit("\nend"))).alias("robots"))


@query(f"with {HOST_PAGES} select host, {STATE_SQL} as robots from h")
def robots_log(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d)


@query(f"with {HOST_PAGES} select doc_id, coalesce(case when n is null then null else {STATE_SQL} end, 'not recorded') as robots from documents left join h on h.host = documents.source")
def robots_state(spark: SparkSession, d: str) -> DataFrame:
    """Each document's robots state by its host's log."""
    docs = docs_of(spark, d)
    logs = _logs(spark, d)
    return docs.join(logs, docs["source"] == logs["host"], "left").select("doc_id", F.coalesce("robots", F.lit("not recorded")).alias("robots"))


SEED_HOSTS = ("", "", "bible", "x.jw.org", "facebook.com", "", "ha.wikinews.org")
SEED_SQL = f"case {pick_sql(SEED_HOSTS, 'page_id')} when '' then {site_sql('url')} when 'bible' then 'bible' || page_id || '.org' else {pick_sql(SEED_HOSTS, 'page_id')} end"
SEED_CTE = rf"""s as (select {SEED_SQL} as h, max(lang) as lang from apply_filters where url is not null group by 1),
    o as (select h as host, coalesce(lang, '') as lang, case when list_has_any({DROPPED_SQL}, {parents_sql('h')}) then 'blocked' when regexp_matches(h, '(?i)^(?:[\w-]+\.)*(jw\.org|bible\w*\.\w+|facebook\.\w+|wikinews\.org)$') then 'never' else 'seed' end as outcome from s)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """(host, lang, outcome) of candidate hosts: the tables' hosts, some replaced by families that are never seeds."""
    kind = pick(SEED_HOSTS, "page_id")
    host = F.when(kind == "", U.site(F.col("url"))).when(kind == "bible", F.concat(F.lit("bible"), F.col("page_id").cast("string"), F.lit(".org"))).otherwise(kind)
    hosts = table(spark, d, "apply_filters").where("url is not null").groupBy(host.alias("host")).agg(F.max("lang").alias("lang"))
    why = rules.first_of((rules.blocked(F.col("host"), F.array(*map(F.lit, DROPPED))), "blocked"), (rules.never_seed(F.col("host")), "never"))
    return hosts.select("host", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(why, F.lit("seed")).alias("outcome"))


@query(f"with {SEED_CTE} select host from o where outcome = 'seed'")
def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Hosts to crawl: without blocked hosts and those that are never seeds."""
    return _candidates(spark, d).where("outcome = 'seed'").select("host")


@query(f"with {SEED_CTE} select lang, outcome, count(*) as n from o group by 1, 2")
def seed_counts(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).groupBy("lang", "outcome").agg(F.count("*").alias("n"))
