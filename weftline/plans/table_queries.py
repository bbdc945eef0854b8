"""Queries on labels, scores, budgets, funnels and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import bpe
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import labels as L
from weftline.operators import reports, sampling
from weftline.plans.base import pick, pick_sql, query, score_sql, site_sql, tokens_sql
from weftline.plans.dedup_queries import score
from weftline.session import cut, table


def sized(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, site, n): tokens and one for the end mark."""
    toks = T.tokens(T.nfc(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.col("source").alias("site"), (F.size(toks) + 1).cast("long").alias("n"))


SIZED_CTE = f"sized as (select doc_id, coalesce(lang, '') as lang, source as site, (len({tokens_sql('text')}) + 1)::BIGINT as n from documents)"


# --- labels and scores

VOTES_CTE = r"""valid as (select *, row_number() over (partition by doc_id order by coalesce(labelled_at, TIMESTAMP '9999-01-01'), coalesce(annotator, ''), label, coalesce(url, '')) as r from build_label_dataset
        where doc_id is not null and lower(trim(coalesce(status, ''))) <> 'void' and label is not null),
    votes as (select doc_id, max(case when r = 1 then lang end) as lang, max(case when r = 1 then url end) as url, max(case when r = 1 then shared end) as shared, count(*) as n_labels, sum((label = 1)::INT)::BIGINT as keeps from valid group by 1),
    voted as (select *, regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host, round(greatest(keeps / n_labels, 1 - keeps / n_labels), 3) as agreement from votes),
    test as (select *, (keeps * 2 > n_labels)::INT as keep from voted where shared = 1 and n_labels >= 2 and keeps * 2 <> n_labels),
    train as (select *, (keeps * 2 >= n_labels)::INT as keep from voted where shared <> 1 and host not in (select host from test))"""


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    voted = L.votes(table(spark, d, "build_label_dataset"))
    test = L.test_set(voted)
    return L.train_set(voted, test), test


@query(f"with {VOTES_CTE} select doc_id, lang, host, n_labels, keeps, agreement from voted")
def label_votes(spark: SparkSession, d: str) -> DataFrame:
    return L.votes(table(spark, d, "build_label_dataset")).select("doc_id", "lang", "host", "n_labels", "keeps", "agreement")


@query(f"with {VOTES_CTE} select doc_id, host, keep, 'test' as split from test union all select doc_id, host, keep, 'train' from train")
def host_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return test.select("doc_id", "host", "keep", F.lit("test").alias("split")).union(train.select("doc_id", "host", "keep", F.lit("train")))


@query(f"with {VOTES_CTE} select coalesce(lang, '') as lang, sum(keep)::BIGINT as keep, sum(1 - keep)::BIGINT as drop_ from train group by 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    train, _ = _split(spark, d)
    wide = train.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).pivot("keep", [1, 0]).count()
    return wide.select("lang", F.coalesce("1", F.lit(0)).alias("keep"), F.coalesce("0", F.lit(0)).alias("drop_"))


@query("select distinct doc_id, annotator, (label = 1)::INT as keep from build_label_dataset where label is not null")
def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "build_label_dataset").where("label is not null").select("doc_id", "annotator", (F.col("label") == 1).cast("int").alias("keep")).distinct()


@query(f"""with {VOTES_CTE}, s as (select coalesce(lang, '') as lang, keep, ({score_sql('doc_id')} > 0.5)::INT as hit from test), e as (select unnest([lang, 'all']) as lang, keep, hit from s)
    select lang, count(*) as n, round(sum((hit = keep)::INT) / greatest(1, count(*)), 4) as accuracy, round(sum(hit * keep) / greatest(1, sum(hit)), 4) as precision, round(sum(hit * keep) / greatest(1, sum(keep)), 4) as recall, round(sum(keep) / greatest(1, count(*)), 4) as base from e group by 1""")
def cls_metrics(spark: SparkSession, d: str) -> DataFrame:
    _, test = _split(spark, d)
    return L.metrics(test.withColumn("p", score("doc_id")))


@query()
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Keep probability of every pool record by the model of the labelled training split; checked on held-out labels in the tests."""
    train, _ = _split(spark, d)
    texts = table(spark, d, "build_label_dataset").select("doc_id", "text").where("text is not null").dropDuplicates(["doc_id"])
    return L.keep_probability(train.join(texts, "doc_id").select("text", "keep"), table(spark, d, "build_a").select("id", "text").distinct())


@query()
def cls_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the real model: fitted on the training split, measured on the test split, whose hosts it doesn't know."""
    train, test = _split(spark, d)
    texts = table(spark, d, "build_label_dataset").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    scored = L.keep_probability(train.join(texts, "doc_id").select("text", "keep"), test.join(texts, "doc_id").select("doc_id", "text"), "doc_id")
    return L.metrics(test.join(scored.withColumnRenamed("id", "doc_id"), "doc_id"))


@query(f"select id, case when id like '%7' then 0.9 else {score_sql('id')} end as p from (select distinct id from build_a)")
def score_override(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "build_a").select("id").distinct()
    return L.latest_scores(ids.select("id", score("id").alias("p")), ids.where("id like '%7'").select("id", F.lit(0.9).alias("p")))


@query(f"select id from (select distinct id from build_a) where {score_sql('id')} > 0.5")
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "build_a").select("id").distinct().where(score("id") > 0.5)


@query(f"select id, {score_sql('id')} as p from (select distinct id from build_a) where id not like 'P00-00000%'")
def incremental_score(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "build_a").select("id").distinct()
    done = ids.where("id like 'P00-00000%'")
    return ids.join(done, "id", "left_anti").select("id", score("id").alias("p"))


# --- budgets and samples

BUDGETS = "budgets as (select lang, (sum(n) * 4) // 10 as budget from sized group by 1)"


@query(f"with {SIZED_CTE}, r as (select doc_id, lang, n, sum(n) over (partition by lang order by md5('0:' || doc_id), doc_id rows unbounded preceding) as running from sized) select doc_id, lang, running::BIGINT as running from r where running <= 5000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sampling.budget_prefix(sized(spark, d), 5000, "doc_id", "n", ["lang"]).select("doc_id", "lang", "running")


@query(f"""with recursive {SIZED_CTE}, {BUDGETS}, o as (select lang, doc_id, n, budget, row_number() over (partition by lang order by md5('3:' || doc_id), doc_id) as r from sized join budgets using (lang)),
    f as (select lang, doc_id, r, budget, n <= budget as take, case when n <= budget then n else 0 end as got from o where r = 1
        union all select o.lang, o.doc_id, o.r, o.budget, f.got + o.n <= o.budget, f.got + case when f.got + o.n <= o.budget then o.n else 0 end from f join o on o.lang = f.lang and o.r = f.r + 1)
    select lang, doc_id from f where take""")
def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    docs = sized(spark, d)
    budgets = docs.groupBy("lang").agg(F.floor(F.sum("n") * 4 / 10).alias("budget"))
    return sampling.greedy_fill(docs, budgets, "doc_id", "n", "lang", 3)


@query()
def site_cap(spark: SparkSession, d: str) -> DataFrame:
    """No site over a fifth of its language's tokens; invariants are tested."""
    return sampling.site_cap(sized(spark, d), 0.2, "doc_id", "n", "lang", "site")


QUOTA_CTE = "quota as (select lang, min(tokens)::BIGINT as budget from (select lang, doc_id % 3 as version, sum(n) as tokens from sized group by 1, 2) group by 1)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return sized(spark, d).withColumn("version", F.col("doc_id") % 3)


@query(f"with {SIZED_CTE}, {QUOTA_CTE} select lang, budget as quota from quota")
def lang_quota(spark: SparkSession, d: str) -> DataFrame:
    return sampling.language_quota(_versions(spark, d), "version", "lang", "n").select("lang", F.col("budget").alias("quota"))


def fill_sql(rows: str, group: str, seed: int) -> str:
    """CTEs up to ``filled``: a greedy pass over ``rows`` (group, doc_id, n, budget)."""
    return f"""o as (select {group}, doc_id, n, budget, row_number() over (partition by {group} order by md5('{seed}:' || doc_id), doc_id) as r from {rows}),
    f as (select {group}, doc_id, r, budget, n <= budget as take, case when n <= budget then n else 0 end as got from o where r = 1
        union all select o.{group}, o.doc_id, o.r, o.budget, f.got + o.n <= o.budget, f.got + case when f.got + o.n <= o.budget then o.n else 0 end from f join o on o.{group} = f.{group} and o.r = f.r + 1),
    filled as (select {group}, doc_id from f where take)"""


@query(f"with recursive {SIZED_CTE}, {QUOTA_CTE}, v as (select doc_id % 3 || ':' || lang as part, doc_id, n, budget from sized join quota using (lang)), {fill_sql('v', 'part', 5)} select part, doc_id from filled")
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every version filled up to its languages' quotas."""
    docs = _versions(spark, d)
    quota = sampling.language_quota(docs, "version", "lang", "n")
    part = F.concat_ws(":", F.col("version").cast("string"), "lang").alias("part")
    budgets = docs.select("version", "lang").distinct().join(quota, "lang").select(part, "budget")
    return sampling.greedy_fill(docs.select(part, "doc_id", "n"), budgets, "doc_id", "n", "part", 5)


@query(f"with recursive {SIZED_CTE}, b as (select min(tokens)::BIGINT as budget from (select sum(n) as tokens from sized group by doc_id % 3)), v as (select doc_id % 3 as version, doc_id, n, budget from sized, b), {fill_sql('v', 'version', 6)} select version, doc_id from filled")
def budget_global(spark: SparkSession, d: str) -> DataFrame:
    """Every version filled up to the smallest version's tokens."""
    docs = _versions(spark, d)
    return sampling.greedy_fill(docs, sampling.global_budget(docs, "version", "n"), "doc_id", "n", "version", 6)


@query(f"with {SIZED_CTE} select ((row_number() over (order by n desc, doc_id) - 1) // 64)::BIGINT as batch, doc_id as id, n as size from sized")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.length_batches(sized(spark, d), "doc_id", "n", 64)


@query()
def token_count(spark: SparkSession, d: str) -> DataFrame:
    """Documents and subword tokens by language, by the public vocabulary; round trips are tested."""
    counted = bpe.with_token_count(table(spark, d, "documents"), "text")
    return counted.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query()
def budget_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A budget of subword tokens by language, filled greedily; the fill is checked by ``budget_greedy``."""
    docs = bpe.with_token_count(table(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")), "text").select("doc_id", "lang", "n")
    docs = cut(docs, "tokens")  # encoded once
    budgets = docs.groupBy("lang").agg(F.floor(F.sum("n") * 4 / 10).alias("budget"))
    return sampling.greedy_fill(docs, budgets, "doc_id", "n", "lang", 3)


@query("select pass, count(*) as n, count(distinct doc_id) as ids from documents, (select unnest([1, 2, 3]) as pass) group by 1")
def epoch_sampler(spark: SparkSession, d: str) -> DataFrame:
    each = sampling.epochs(table(spark, d, "documents"), 3, "doc_id")
    return each.groupBy("pass").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("select id, label from (select doc_id as id, md5('0:' || doc_id) as label from documents) order by label, id limit 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the first 50 of the seeded order."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.seeded_order(0, F.col("doc_id")).alias("label")).orderBy("label", "id").limit(50)


# --- reports

@query(f"with {SIZED_CTE}, s as (select lang, unnest(['all', case when n >= 100 then 'long' end, case when n >= 100 and doc_id % 2 = 0 then 'even' end]) as stage, n from sized) select lang, stage, count(*) as docs, sum(n)::BIGINT as tokens from s where stage is not null group by 1, 2")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens left after each step, in one pass over tagged rows."""
    long = F.col("n") >= 100
    stages = F.array_compact(F.array(F.lit("all"), F.when(long, "long"), F.when(long & (F.col("doc_id") % 2 == 0), "even")))
    return sized(spark, d).select("lang", F.explode(stages).alias("stage"), "n").groupBy("lang", "stage").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query(f"with {SIZED_CTE}, s as (select lang, site, sum(n)::BIGINT as tokens from sized group by 1, 2), r as (select *, round(tokens / sum(tokens) over (partition by lang), 6) as share, row_number() over (partition by lang order by tokens desc, site) as rank from s) select * from r where rank <= 10")
def top_sites(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_share(sized(spark, d), "lang", "site", "n", 10)


@query("select coalesce(lang, 'all') as lang, count(distinct source) as sites, count(distinct doc_id) as ids from documents where lang is not null group by grouping sets ((lang), ())")
def distinct_sites(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang is not null")
    return docs.rollup("lang").agg(F.count_distinct("source").alias("sites"), F.count_distinct("doc_id").alias("ids")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "sites", "ids")


PROFILE_SITES = ("", "jw.org", "", "wol.jw.org", "", "biblica.example", "ha.wikipedia.org", "mybeblia.example", "ajw.org", "")


@query(f"""with {SIZED_CTE}, m as (select *, case when {pick_sql(PROFILE_SITES, 'doc_id')} = '' then site else {pick_sql(PROFILE_SITES, 'doc_id')} end as s from sized), e as (select unnest([lang, 'all']) as lang, s, n from m),
    t as (select lang, s, sum(n) as n, row_number() over (partition by lang order by sum(n) desc, s) as r from e group by 1, 2)
    select lang, sum(n)::BIGINT as tokens, round(sum(case when s in ('jw.org', 'wol.jw.org', 'biblica.example', 'mybeblia.example') then n else 0 end) / sum(n), 6) as bible_share, round(sum(case when s = 'ha.wikipedia.org' then n else 0 end) / sum(n), 6) as wiki_share, round(sum(case when r <= 10 then n else 0 end) / sum(n), 6) as top_share from t group by 1""")
def profile(spark: SparkSession, d: str) -> DataFrame:
    """Token shares of Bible sites, wikis and the ten largest sites, by language and over all; some sites are named so that the classes occur."""
    kind = pick(PROFILE_SITES, "doc_id")
    return reports.profile(sized(spark, d).withColumn("site", F.when(kind == "", F.col("site")).otherwise(kind)), "lang", "site", "n")


@query(f"""with {SIZED_CTE}, s as (select site, sum(n) as tokens, count(*) as docs from sized group by 1), b as (select *, sum(tokens) over () as total from s), g as (select * from b where tokens > 0.05 * total),
    r as (select sized.*, g.tokens, g.total, sum(n) over (partition by site order by {score_sql('doc_id::VARCHAR')} desc, doc_id rows unbounded preceding) as running from sized join g using (site)),
    k as (select site, count(*) as kept_docs, sum(n) as kept_tokens from r where running <= 0.05 / (1 - 0.05) * (total - tokens) group by 1)
    select site, docs, coalesce(kept_docs, 0) as kept_docs, tokens::BIGINT as tokens, coalesce(kept_tokens, 0)::BIGINT as kept_tokens from g left join k using (site)""")
def capped_alternative(spark: SparkSession, d: str) -> DataFrame:
    docs = sized(spark, d).withColumn("p", score(F.col("doc_id").cast("string")))
    return reports.capped_alternative(docs, 0.05, "site", "n", "p", "doc_id")


@query(f"with {SIZED_CTE}, s as (select doc_id % 3 as version, lang, sum(n)::BIGINT as tokens from sized group by 1, 2) select version, lang, tokens, round(tokens / sum(tokens) over (partition by version), 6) as share from s")
def token_mix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    sums = sized(spark, d).groupBy((F.col("doc_id") % 3).alias("version"), "lang").agg(F.sum("n").alias("tokens"))
    return sums.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("version")), 6))


CURVES_CTE = f"""dw as (select doc_id % 3 as v, doc_id % 4 as seed, unnest({tokens_sql('text')}) as w from documents), dc as (select v, seed, w, count(*) as c from dw group by 1, 2, 3), dn as (select v, seed, sum(c) as total, count(*) as kinds from dc group by 1, 2),
    hw as (select set_name, w, count(*) as c from (select set_name, unnest({tokens_sql('text')}) as w from held_out) group by 1, 2), hb as (select set_name, sum(octet_length(encode(text))) as bytes from held_out group by 1),
    nat as (select v, seed, set_name, sum(-hw.c * ln((coalesce(dc.c, 0) + 1) / (total + kinds + 1))) as nats from hw cross join dn left join dc using (v, seed, w) group by 1, 2, 3),
    curves as (select 'v' || v as version, set_name as held_set, seed, round(nats / bytes / ln(2), 4) as bpb from nat join hb using (set_name))"""


def _curves(spark: SparkSession, d: str) -> DataFrame:
    """(version, held_set, seed, bpb): bits per byte of the held-out sets under word frequencies of thirds of the documents, a quarter a seed."""
    words = lambda t, *keys: t.select(*keys, F.explode(T.tokens(T.nfc(F.coalesce("text", F.lit(""))))).alias("w"))
    counts = words(table(spark, d, "documents"), (F.col("doc_id") % 3).alias("v"), (F.col("doc_id") % 4).alias("seed")).groupBy("v", "seed", "w").agg(F.count("*").alias("c"))
    totals = counts.groupBy("v", "seed").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    held = table(spark, d, "held_out")
    sets = words(held, "set_name").groupBy("set_name", "w").agg(F.count("*").alias("n"))
    n_bytes = held.groupBy("set_name").agg(F.sum(F.octet_length("text")).alias("bytes"))
    every = sets.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    p = (F.coalesce("c", F.lit(0)) + 1) / (F.col("total") + F.col("kinds") + 1)
    nats = every.join(totals, ["v", "seed"]).join(counts, ["v", "seed", "w"], "left").groupBy("v", "seed", "set_name").agg(F.sum(-F.col("n") * F.log(p)).alias("nats"))
    return nats.join(n_bytes, "set_name").select(F.concat(F.lit("v"), F.col("v").cast("string")).alias("version"), F.col("set_name").alias("held_set"), "seed", reports.bits_per_byte(F.col("nats"), F.col("bytes")).alias("bpb"))


@query(f"with {CURVES_CTE} select * from curves")
def bpb(spark: SparkSession, d: str) -> DataFrame:
    return _curves(spark, d)


@query(f"with {CURVES_CTE} select version, held_set, round(avg(bpb), 4) as mean, min(bpb) as low, max(bpb) as high from curves group by 1, 2")
def seed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Mean and range over seeds of each version on each held-out set."""
    return reports.seed_ranges(_curves(spark, d))


@query(f"""with {CURVES_CTE}, m as (select version, held_set, min(bpb) as low, max(bpb) as high from curves group by 1, 2)
    select x.version as a, y.version as b, sum((x.high < y.low)::INT)::BIGINT as wins, sum((x.low > y.high)::INT)::BIGINT as losses, sum((not x.high < y.low and not x.low > y.high)::INT)::BIGINT as unclear from m x join m y using (held_set) where x.version < y.version group by 1, 2""")
def compare_versions(spark: SparkSession, d: str) -> DataFrame:
    """Win, loss or unclear between versions over held-out sets."""
    return reports.compare_versions(_curves(spark, d))


@query(r"""with p as (select item_id, text, regexp_extract_all(text, '[ \n]*[^ \n]+|[ \n]+') as p from held_out) select item_id, list_sum(list_transform(p[2:8], lambda x: octet_length(encode(x))))::INT as scored from p""")
def scored_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the pieces that a loss is taken on in a context of 8; words with the space before them stand for tokens."""
    pieces = F.regexp_extract_all("text", F.lit(r"[ \n]*[^ \n]+|[ \n]+"), F.lit(0))
    return table(spark, d, "held_out").select("item_id", F.nullif(reports.scored_bytes(pieces, F.col("text"), 8), F.lit(0)).alias("scored"))


@query("with s as (select count(*) as steps from documents) select distinct least(steps, p)::BIGINT as step from s, (select unnest(list_transform(range(2, 40), lambda i: round_even(2 ** (i / 2), 0)::BIGINT)) as p union all select 0 union all select 1000000000) order by 1")
def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The steps at which a run of as many steps as there are documents is measured."""
    return spark.createDataFrame([(s,) for s in reports.checkpoints(table(spark, d, "documents").count())], "step long")


@query(f"""with pages as (select {site_sql('url')} as host, max(lid_prob) as lid_score, max(split_part(wet_file, '/', 2)) as snapshot from apply_filters where url is not null group by 1), p as (select distinct id, url, text from build_a)
    select id, host as domain, case when snapshot is null then 'unknown' else 'cc' end as source, snapshot, round(lid_score, 6) as lid_score from (select id, url, {site_sql('url')} as host from p) left join pages using (host)""")
def release_join(spark: SparkSession, d: str) -> DataFrame:
    """Release rows: each pool record with what is known of its source; left joins on narrow keys."""
    pages = table(spark, d, "apply_filters").where("url is not null").groupBy(U.site(F.col("url")).alias("domain")).agg(F.max("lid_prob").alias("lid_score"), F.max(F.split_part("wet_file", F.lit("/"), F.lit(2))).alias("snapshot"))
    pool = table(spark, d, "build_a").distinct().select("id", U.site(F.col("url")).alias("domain"))
    joined = pool.join(pages, "domain", "left")
    return joined.select("id", "domain", F.when(F.col("snapshot").isNull(), "unknown").otherwise("cc").alias("source"), "snapshot", F.round("lid_score", 6).alias("lid_score"))


# --- general relational queries

@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey join nation on c_nationkey = n_nationkey group by 1")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n", "total")


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The windowed counts as a stream with a watermark and duplicate removal, run over all events."""
    from weftline.streaming.ingest import run_windowed_counts

    return run_windowed_counts(spark, d, "events.parquet", EVENT)
