"""Queries on near-duplicates, joins between corpora, and decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import boilerplate, decontam, labels, minhash, reports
from weftline.operators.components import star_edges
from weftline.plans.base import dedup_url_sql, grams_sql, query, score_sql, site_sql, strip_sql, tokens_sql
from weftline.session import cut, table

LONGS = lambda xs: "[" + ", ".join(f"{int(x)}::HUGEINT" for x in xs) + "]"
SIGNED_CTE = f"""dt as (select doc_id, {tokens_sql('text')} as w from documents),
    dg as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) else [array_to_string(w, ' ')] end) as g from dt),
    dh as (select doc_id, ('0x' || substr(md5(g), 1, 15))::BIGINT::HUGEINT as h from dg),
    ab as (select unnest({LONGS(minhash.A)}) as a, unnest({LONGS(minhash.B)}) as b, unnest(range(0, 112)) as k),
    dm as (select doc_id, k, min(((h * a + b) % 18446744073709551616::HUGEINT) % 2305843009213693951::HUGEINT) as m from dh, ab group by 1, 2),
    sigs as (select doc_id, list(m::BIGINT order by k) as sig from dm group by 1)"""
BANDS_CTE = SIGNED_CTE + """,
    bands as (select distinct doc_id, b::INT as band, ('0x' || substr(md5(array_to_string(sig[b * 8 + 1:b * 8 + 8], ',')), 1, 15))::BIGINT as key from sigs, (select unnest(range(0, 14)) as b))"""
CLUSTERS_CTE = BANDS_CTE + """,
    star as (select distinct min(doc_id) over (partition by band, key) as a, doc_id as b from bands),
    sym as (select a, b from star where a <> b union select b, a from star where a <> b),
    reach as (select doc_id as a, doc_id as b from documents union select reach.a, sym.b from reach join sym on reach.b = sym.a),
    clusters as (select a as doc_id, min(b) as cluster from reach group by 1)"""


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return minhash.duplicate_clusters(docs_of(spark, d))


@query(f"with {SIGNED_CTE} select doc_id, sig[1] as first, md5(array_to_string(sig, ',')) as digest from sigs")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return minhash.signed(docs_of(spark, d).select("doc_id", "text")).select("doc_id", F.col("sig")[0].alias("first"), F.md5(F.array_join("sig", ",")).alias("digest"))


@query(f"with {BANDS_CTE} select doc_id, band, key from bands")
def band_keys(spark: SparkSession, d: str) -> DataFrame:
    return minhash.banded(docs_of(spark, d))


@query(f"with {BANDS_CTE} select band, key, min(doc_id) as root, count(*) as members from bands group by 1, 2 having count(*) > 1")
def lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return minhash.banded(docs_of(spark, d)).groupBy("band", "key").agg(F.min("doc_id").alias("root"), F.count("*").alias("members")).where("members > 1")


@query(f"with recursive {CLUSTERS_CTE} select doc_id, cluster from clusters")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d)


@query(f"with recursive {CLUSTERS_CTE}, r as (select doc_id, cluster, snapshot, row_number() over (partition by cluster, snapshot order by doc_id) as n from clusters join documents using (doc_id)) select doc_id, cluster, snapshot from r where n > 1")
def drop_per_snapshot(spark: SparkSession, d: str) -> DataFrame:
    joined = clusters(spark, d).join(docs_of(spark, d).select("doc_id", "snapshot"), "doc_id")
    return minhash.beyond_first(joined, ["cluster", "snapshot"], ["doc_id"]).select("doc_id", "cluster", "snapshot")


@query(f"with recursive {CLUSTERS_CTE} select doc_id, cluster from clusters where doc_id <> cluster")
def drop_global(spark: SparkSession, d: str) -> DataFrame:
    return minhash.beyond_first(clusters(spark, d), ["cluster"], ["doc_id"])


@query(f"with recursive {CLUSTERS_CTE} select cluster, arg_min(doc_id, ({dedup_url_sql('url')}, doc_id)) as kept from clusters join documents using (doc_id) group by 1")
def keep_min_url(spark: SparkSession, d: str) -> DataFrame:
    joined = clusters(spark, d).join(docs_of(spark, d).select("doc_id", U.dedup_url(F.col("url")).alias("u")), "doc_id")
    return joined.groupBy("cluster").agg(F.min_by("doc_id", F.struct("u", "doc_id")).alias("kept"))


@query(f"with recursive {CLUSTERS_CTE} select cluster, arg_min(doc_id, (fetched, doc_id)) as kept from clusters join documents using (doc_id) group by 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    joined = clusters(spark, d).join(docs_of(spark, d).select("doc_id", "fetched"), "doc_id")
    return joined.groupBy("cluster").agg(F.min_by("doc_id", F.struct("fetched", "doc_id")).alias("kept"))


@query(f"with recursive {CLUSTERS_CTE}, s as (select cluster, count(*) as size from clusters group by 1) select size, count(*) as n_clusters from s group by 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d).groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))


@query(f"""with recursive {CLUSTERS_CTE}, s as (select cluster, count(*) as size, count(distinct snapshot) as crawls from clusters join documents using (doc_id) group by 1)
    select count(*) as n_clusters, sum(crawls - 1)::BIGINT as cross_snapshot, sum(case when size < 30 then size else 0 end)::BIGINT as in_small from s""")
def cross_snapshot(spark: SparkSession, d: str) -> DataFrame:
    joined = clusters(spark, d).join(docs_of(spark, d).select("doc_id", "snapshot"), "doc_id")
    each = joined.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct("snapshot").alias("crawls"))
    return each.agg(F.count("*").alias("n_clusters"), F.sum(F.col("crawls") - 1).alias("cross_snapshot"), F.sum(F.when(F.col("size") < 30, F.col("size")).otherwise(0)).alias("in_small"))


RECRAWLED = "recrawled as (select doc_id, source, url, text from documents union all select doc_id + 1000000000, source, 'https://a.example/' || doc_id, text from documents where doc_id % 4 = 0)"


@query(f"with {RECRAWLED}, r as (select doc_id, source, row_number() over (partition by source, md5(text) order by {dedup_url_sql('url')}, doc_id) as n from recrawled where text is not null) select doc_id, source from r where n > 1")
def exact_dup(spark: SparkSession, d: str) -> DataFrame:
    """Documents and copies of a quarter of them under other urls: all but the smallest url of a host's equal texts."""
    docs = docs_of(spark, d).select("doc_id", "source", "url", "text")
    copies = docs.where("doc_id % 4 = 0").select(F.col("doc_id") + 1_000_000_000, "source", F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string")), "text")
    rows = docs.union(copies).where("text is not null").select("doc_id", "source", F.md5("text").alias("h"), U.dedup_url(F.col("url")).alias("u"))
    return minhash.beyond_first(rows, ["source", "h"], ["u", "doc_id"]).select("doc_id", "source")


@query(f"""with p as (select distinct page_id, {site_sql('url')} as host, coalesce(wet_text, '') as x from apply_filters),
    e as (select page_id, host, unnest(string_split(x, chr(10))) as raw, generate_subscripts(string_split(x, chr(10)), 1) as i from p),
    f as (select host, {strip_sql('raw')} as line from (select distinct page_id, host, raw from e) group by 1, 2 having count(*) >= 20),
    c as (select e.page_id, string_agg(e.raw, chr(10) order by e.i) as body from e left join f on e.host = f.host and {strip_sql('e.raw')} = f.line where f.line is null group by 1)
    select p.page_id, coalesce(len(regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{N}}_]+')), 0) >= 20 as uses_body from (select distinct page_id from p) p left join c using (page_id)""")
def body_keys(spark: SparkSession, d: str) -> DataFrame:
    """Which text a re-crawled page's keys come from: its body if that has 20 words, else the whole."""
    pages = table(spark, d, "apply_filters").select("page_id", U.site(F.col("url")).alias("host"), F.coalesce("wet_text", F.lit("")).alias("x")).distinct()
    body = boilerplate.body(pages, "page_id", "host", "x")
    return body.select("page_id", (F.size(F.regexp_extract_all("body", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))) >= 20).alias("uses_body"))


# --- decontamination

HELD_CTE = f"ht as (select set_name, {tokens_sql('text')} as w from held_out), hg as ({grams_sql('ht', 'set_name', 13)}), qt as (select doc_id, {tokens_sql('text')} as w from documents), qg as ({grams_sql('qt', 'doc_id', 13)})"


@query(f"with {HELD_CTE} select lang, count(*) as docs, sum((c.doc_id is not null)::INT)::BIGINT as dropped from documents left join (select distinct doc_id from qg where gram in (select gram from hg)) c using (doc_id) group by 1")
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d)
    bad = decontam.contaminated(docs, table(spark, d, "held_out")).withColumn("bad", F.lit(1))
    return docs.select("doc_id", "lang").join(bad, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.count("bad").alias("dropped"))


@query(f"with {HELD_CTE} select distinct doc_id, set_name from qg join hg using (gram)")
def contam_by_set(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contamination_by_set(docs_of(spark, d), table(spark, d, "held_out"))


@query("select doc_id from documents where doc_id % 97 = 3 or (url is not null and doc_id % 89 = 5) group by 1")
def identity_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Hold-out by id and by page title: a seeded choice of documents stands for the held-out wiki pages."""
    docs = docs_of(spark, d)
    page = F.concat(F.lit("https://ha.wikipedia.org/wiki/Shafi_"), F.col("doc_id").cast("string"))
    pages = docs.select("doc_id", F.when(F.col("url").isNotNull(), page).alias("url"))
    held = docs.select(F.when(F.col("doc_id") % 97 == 3, F.col("doc_id")).alias("id"), F.when(F.col("doc_id") % 89 == 5, F.concat(F.lit("shafi "), F.col("doc_id").cast("string"))).alias("title"))
    return decontam.identity_held(pages, held, "doc_id")


# --- joins between corpora: the pool is the earlier snapshots, what is folded in the last one

POOL = "snapshot < (select max(snapshot) from documents)"


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = docs_of(spark, d)
    last = docs.agg(F.max("snapshot")).first()[0]  # one value
    return docs.where(F.col("snapshot") < last), docs.where(F.col("snapshot") == last)


@query(f"with recursive {CLUSTERS_CTE} select doc_id from documents where doc_id not in (select doc_id from clusters where doc_id <> cluster)")
def anti_drop(spark: SparkSession, d: str) -> DataFrame:
    """The documents without those on the drop list of near-duplicates."""
    return docs_of(spark, d).select("doc_id").join(drop_global(spark, d).select("doc_id"), "doc_id", "left_anti")


@query(f"with recursive {CLUSTERS_CTE} select source, count(*) as docs, sum((doc_id <> cluster)::INT)::BIGINT as dropped from clusters join documents using (doc_id) group by 1")
def drop_by_host(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each host the drop list takes."""
    return reports.dropped_by(docs_of(spark, d), drop_global(spark, d), "doc_id", "source")


@query(f"""with {BANDS_CTE}, pool as (select * from documents where {POOL}), new as (select * from documents where not ({POOL}))
    select doc_id from new where {dedup_url_sql('url')} not in (select {dedup_url_sql('url')} from pool where url is not null) and doc_id not in (select b.doc_id from bands b join bands p using (band, key) where p.doc_id in (select doc_id from pool))""")
def anti_known(spark: SparkSession, d: str) -> DataFrame:
    """New documents whose url and bands are unknown to the pool: two anti joins, never one with OR."""
    pool, new = _pool(spark, d)
    urls = pool.where("url is not null").select(U.dedup_url(F.col("url")).alias("u")).distinct()
    fresh = new.withColumn("u", U.dedup_url(F.col("url"))).join(urls, "u", "left_anti").select("doc_id")
    keys = cut(minhash.banded(docs_of(spark, d)), "bands")  # signed once, used twice
    known = keys.join(pool.select("doc_id"), "doc_id", "left_semi").select("band", "key").distinct()
    met = keys.join(new.select("doc_id"), "doc_id", "left_semi").join(known, ["band", "key"], "left_semi").select("doc_id").distinct()
    return fresh.join(met, "doc_id", "left_anti")


@query(f"with {BANDS_CTE} select doc_id from documents where not ({POOL}) and doc_id not in (select b.doc_id from bands b join bands p using (band, key) where p.doc_id in (select doc_id from documents where {POOL}))")
def anti_bandkey(spark: SparkSession, d: str) -> DataFrame:
    pool, new = _pool(spark, d)
    keys = cut(minhash.banded(docs_of(spark, d)), "bands")  # signed once, used twice
    known = keys.join(pool.select("doc_id"), "doc_id", "left_semi").select("band", "key").distinct()
    met = keys.join(new.select("doc_id"), "doc_id", "left_semi").join(known, ["band", "key"], "left_semi").select("doc_id").distinct()
    return new.select("doc_id").join(met, "doc_id", "left_anti")


@query(f"""with {BANDS_CTE}, pool as (select * from documents where {POOL}), new as (select * from documents where not ({POOL}))
    select case when md5(text) in (select md5(text) from pool) then 'same text' when doc_id in (select b.doc_id from bands b join bands p using (band, key) where p.doc_id in (select doc_id from pool)) then 'shared band' else 'apart' end as overlap, count(*) as n from new group by 1""")
def corpus_overlap(spark: SparkSession, d: str) -> DataFrame:
    pool, new = _pool(spark, d)
    texts = pool.where("text is not null").select(F.md5("text").alias("h")).distinct().withColumn("same", F.lit(True))
    keys = cut(minhash.banded(docs_of(spark, d)), "bands")  # signed once, used twice
    known = keys.join(pool.select("doc_id"), "doc_id", "left_semi").select("band", "key").distinct()
    met = keys.join(new.select("doc_id"), "doc_id", "left_semi").join(known, ["band", "key"], "left_semi").select("doc_id").distinct().withColumn("band", F.lit(True))
    both = new.select("doc_id", F.md5("text").alias("h")).join(texts, "h", "left").join(met, "doc_id", "left")
    return both.groupBy(F.when(F.col("same"), "same text").when(F.col("band"), "shared band").otherwise("apart").alias("overlap")).agg(F.count("*").alias("n"))


@query("select id, p, p > 0.5 as kept from (select distinct id from build_a) a join (select doc_id as id, round(avg((label = 1)::INT), 4) as p from build_label_dataset where label is not null group by 1) s using (id)")
def join_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pool records with their labels' mean as score; those never labelled may lack one."""
    rows = table(spark, d, "build_label_dataset")
    scores = rows.where("label is not null").groupBy(F.col("doc_id").alias("id")).agg(F.round(F.avg((F.col("label") == 1).cast("int")), 4).alias("p"))
    ids = table(spark, d, "build_a").select("id").distinct()
    unscored = ids.join(scores, "id", "left_anti").withColumn("optional", F.lit(True))
    return labels.join_scores(ids.join(unscored, "id", "left"), scores, optional="optional").select("id", "p", (F.col("p") > 0.5).alias("kept"))


@query("""with p as (select page_id, min(url) as url, min(wet_text) as text, min(wet_file) as wet_file, min(lid_prob) as lid_prob, min(fetched) as fetched from apply_filters group by 1)
    select case page_id % 3 when 0 then page_id::VARCHAR when 1 then 'h:' || page_id else 'fold:' || page_id end as id, case page_id % 3 when 0 then 'cc' when 1 then 'recrawl' else 'fw2' end as source, case when page_id % 3 = 0 then split_part(wet_file, '/', 2) end as snapshot,
        round(case when page_id % 3 < 2 then lid_prob else page_id / 7.0 end, 6) as lid_score, case when page_id % 3 = 1 then strftime(fetched, '%Y-%m-%d %H:%M:%S') end as fetched from p""")
def release_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Pages as release rows of three sources, each looked up where its source is known; a row that isn't its shard's is an error."""
    pages = table(spark, d, "apply_filters").groupBy("page_id").agg(*(F.min(c).alias(c) for c in ("url", "wet_text", "wet_file", "lid_prob", "fetched")))
    kind, key = F.col("page_id") % 3, F.col("page_id").cast("string")
    ids = F.when(kind == 0, key).when(kind == 1, F.concat(F.lit("h:"), key)).otherwise(F.concat(F.lit("fold:"), key))
    docs = pages.select(ids.alias("id"), "url", F.col("wet_text").alias("text"), F.when(kind == 0, "cc").when(kind == 1, "recrawl").otherwise("fw2").alias("source"))
    shards = pages.select(key.alias("id"), "url", F.col("wet_text").alias("text"), "wet_file", "lid_prob")
    again = pages.select(F.concat(F.lit("h:"), key).alias("id"), "lid_prob", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"))
    folded = pages.select(key.alias("id"), (F.col("page_id") / 7.0).alias("language_score"))
    return labels.release_rows(docs, shards, again, folded).select("id", "source", "snapshot", F.round("lid_score", 6).alias("lid_score"), "fetched")


def score(key: str) -> Column:
    return F.round(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") / F.lit(65535.0), 4)


@query(f"select doc_id, n_chars from (select doc_id, length(text) as n_chars, source from documents) where source in (select source from documents group by 1 having count(*) >= 10)")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d)
    large = docs.groupBy("source").agg(F.count("*").alias("n")).where("n >= 10").select("source")
    return docs.join(large, "source", "left_semi").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("select snapshot, count(*) as n from documents where snapshot in (select split_part(wet_file, '/', 2) from apply_filters) group by 1")
def pool_overlap(spark: SparkSession, d: str) -> DataFrame:
    crawls = table(spark, d, "apply_filters").select(F.split_part("wet_file", F.lit("/"), F.lit(2)).alias("snapshot")).distinct()
    shared = docs_of(spark, d).select("snapshot").distinct().intersect(crawls)
    return docs_of(spark, d).join(shared, "snapshot", "left_semi").groupBy("snapshot").agg(F.count("*").alias("n"))


@query("""with named as (select distinct snapshot from documents where snapshot > (select min(snapshot) from documents)), seen as (select distinct regexp_extract(wet_file, 'crawl-data/(CC-MAIN-\\d{4}-\\d{2})/', 1) as snapshot from apply_filters),
    part as (select snapshot from seen where snapshot < (select max(snapshot) from seen))
    select snapshot, 'named only' as side from (select * from named except select * from part) union all select snapshot, 'seen only' from (select * from part except select * from named)""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots that a set names but the first, against those that the pages are of but the last."""
    named = docs_of(spark, d).select("snapshot").distinct()
    seen = table(spark, d, "apply_filters").select(F.regexp_extract("wet_file", r"crawl-data/(CC-MAIN-\d{4}-\d{2})/", 1).alias("snapshot")).distinct()
    first, last = named.agg(F.min("snapshot")).first()[0], seen.agg(F.max("snapshot")).first()[0]  # one value each
    named, seen = named.where(F.col("snapshot") > first), seen.where(F.col("snapshot") < last)
    return named.exceptAll(seen).withColumn("side", F.lit("named only")).union(seen.exceptAll(named).withColumn("side", F.lit("seen only")))


@query("""select source, count(*) as n, count(url) as urls from (select source, url from documents union all select 'pool' as source, url from build_a) group by 1""")
def union_pools(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "build_a").select("url").withColumn("source", F.lit("pool"))
    return docs_of(spark, d).select("source", "url").unionByName(pool, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("url").alias("urls"))


@query(f"""with recursive t as (select distinct {site_sql('url')} as host, split_part(wet_file, '/', 2) as crawl from apply_filters where url is not null),
    e as (select distinct a.host as x, b.host as y from t a join (select crawl, min(host) as host from t group by 1) b using (crawl) where a.host <> b.host),
    w(host, depth) as (select min(host), 0 from t union select case when e.x = w.host then e.y else e.x end, depth + 1 from w join e on w.host in (e.x, e.y) where depth < 2)
    select host, min(depth) as depth from w group by 1""")
def link_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Bounded breadth-first expansion with a visited set, from the first host over links between hosts of a crawl."""
    pages = table(spark, d, "apply_filters").where("url is not null").select(U.site(F.col("url")).alias("host"), F.split_part("wet_file", F.lit("/"), F.lit(2)).alias("crawl")).distinct()
    stars = star_edges(pages, ["crawl"], "host")
    links = stars.union(stars.select("b", "a")).toDF("host", "to").distinct()
    return expand(links, pages.agg(F.min("host").alias("host")), 2)


def expand(links: DataFrame, start: DataFrame, most_depth: int) -> DataFrame:
    """(host, depth) reached from ``start`` by ``links`` (host, to) within ``most_depth`` steps."""
    seen = start.withColumn("depth", F.lit(0))
    front = start
    for depth in range(1, most_depth + 1):
        front = front.join(links, "host").select(F.col("to").alias("host")).distinct().join(seen, "host", "left_anti")
        seen = seen.union(front.withColumn("depth", F.lit(depth)))
    return seen
