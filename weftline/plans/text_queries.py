"""Queries over urls, texts and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import boilerplate as B
from weftline.operators import lid as L
from weftline.operators import reports, rules
from weftline.plans.base import DROPPED, DROPPED_SQL, LINE_END, WS, dedup_url_sql, full_lines_sql, lines_sql, parents_sql, path_sql, pick, pick_sql, query, site_sql, strip_sql, tokens_sql, words_sql
from weftline.session import table

SLUG = r"([^/?#]+)/?(?:[?#].*)?$"
NAMESPACES = ("Musamman:", "Tattaunawar_user:", "", "ISO_3166-2:", "Rukuni:", "oníṣe:", "x?action=edit&t=")
HOSTS = ("ha.shop.com", "yo.legit.ng", "ig.jw.org", "www.tool.com", "news.bbc.com", "voahausa.com", "yor.bbc.co.uk", "ha.wikipedia.org", "biblehub.com", "m.facebook.com")
FOLDERS = ("/yo/x", "/ha-ng/", "/hausa/", "/ig", "/wiki/Kano", "/tag/a", "/IBO")
BANNERS = ("Skip to content", "Home |", "SHARE THIS")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "apply_filters")


def rule_url() -> Column:
    return F.concat(F.lit("https://"), pick(HOSTS, "page_id"), pick(FOLDERS, "page_id"))


RULE_URL = f"'https://' || {pick_sql(HOSTS, 'page_id')} || {pick_sql(FOLDERS, 'page_id')}"


@query(f"select page_id, {site_sql('url')} as host from apply_filters")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", U.site(F.col("url")).alias("host"))


@query(f"select page_id, {dedup_url_sql('url')} as norm from apply_filters")
def url_norm(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", U.dedup_url(F.col("url")).alias("norm"))


@query("select page_id, substr(sha1(url), 1, 16) as id from apply_filters")
def doc_id_sha1(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", U.url_id(F.col("url")).alias("id"))


@query(f"select doc_id, len({tokens_sql('text')}) as n_tokens, md5(array_to_string({tokens_sql('text')}, ' ')) as digest from documents")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = T.tokens(T.nfc(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", toks.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def _shingle_query(spark: SparkSession, d: str, n: int, whole: bool) -> DataFrame:
    toks = table(spark, d, "documents").select("doc_id", T.tokens(T.nfc(F.coalesce("text", F.lit("")))).alias("t"))
    return toks.select("doc_id", T.shingles(F.col("t"), n, whole).alias("g")).select("doc_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_max("g")).alias("greatest"))


def _shingle_sql(n: int, short: str) -> str:
    return f"""with t as (select doc_id, {tokens_sql('text')} as w from documents),
    g as (select doc_id, case when len(w) >= {n} then list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) else {short} end as g from t)
    select doc_id, len(g) as n_grams, md5(list_max(g)) as greatest from g"""


@query(_shingle_sql(13, "[]::VARCHAR[]"))
def shingles13(spark: SparkSession, d: str) -> DataFrame:
    return _shingle_query(spark, d, 13, False)


@query(_shingle_sql(5, "[array_to_string(w, ' ')]"))
def shingles5(spark: SparkSession, d: str) -> DataFrame:
    return _shingle_query(spark, d, 5, True)


@query(f"select page_id, len(regexp_extract_all(wet_text, '{T.MOJIBAKE}')) as marks, len(regexp_extract_all(wet_text, '{T.MOJIBAKE}')) >= 3 as garbled from apply_filters")
def mojibake(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", T.mojibake_marks(F.col("wet_text")).cast("long").alias("marks"), rules.garbled(F.col("wet_text")).alias("garbled"))


@query(f"""select {site_sql('url')} as host, count(*) as pages, sum((len(regexp_extract_all(coalesce(wet_text, ''), '{T.MOJIBAKE}')) >= 1)::INT)::BIGINT as marked from apply_filters group by 1""")
def mojibake_by_host(spark: SparkSession, d: str) -> DataFrame:
    marked = F.coalesce((T.mojibake_marks(F.col("wet_text")) >= 1).cast("long"), F.lit(0))
    return _pages(spark, d).groupBy(U.site(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(marked).alias("marked"))


@query("select page_id, length(wet_text) >= 200 as long_enough, md5(substr(wet_text, 1, 20000)) as digest from apply_filters")
def min_chars(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("wet_text")
    return _pages(spark, d).select("page_id", (F.length(text) >= 200).alias("long_enough"), F.md5(F.substring(text, 1, 20000)).alias("digest"))


HELD_MOST = 12


@query(f"""with r as (select set_name, lang, item_id, {strip_sql("case when set_name = 'news' then 'Take' || chr(10) || text when set_name = 'exam' then text || chr(10) || 'A B' else text end")} as text from held_out),
    k as (select distinct on (set_name, lang, case when set_name = 'flores' then text else item_id::VARCHAR end) *, from r where length(text) > 40 order by item_id),
    o as (select set_name, lang, text, row_number() over (partition by set_name, lang order by case when set_name = 'wiki' then md5('0:' || item_id) else lpad(item_id::VARCHAR, 20, '0') end) as n from k)
    select set_name, lang, text from o where set_name in ('flores', 'exam') or n <= {HELD_MOST}""")
def heldout_prep(spark: SparkSession, d: str) -> DataFrame:
    """Held-out texts by set: different passages, headlines with texts, questions with choices; a seeded sample and a first-so-many are the sets' definitions."""
    held = table(spark, d, "held_out").withColumn("headline", F.when(F.col("set_name") == "news", "Take")).withColumn("choices", F.when(F.col("set_name") == "exam", F.array(F.lit("A"), F.lit("B"))))
    return reports.held_out_texts(held, most=HELD_MOST)


@query("select page_id, strftime(fetched, '%Y-%m-%dT%H:%M:%SZ') as fetched_text, strftime(fetched, '%Y-%m-%d') as day from apply_filters")
def fetched_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.date_format("fetched", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_text"), F.date_format("fetched", "yyyy-MM-dd").alias("day"))


# --- rules

@query("select page_id, lang, coalesce(lang in ('hau_Latn', 'ibo_Latn', 'yor_Latn') and lid_prob >= 0.3, false) as kept from apply_filters")
def lid_gate(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", "lang", rules.lid_gate(F.col("lang"), F.col("lid_prob")).alias("kept"))


@query(rf"select page_id, regexp_matches(split_part({pick_sql(NAMESPACES, 'page_id')} || regexp_extract(coalesce(url, ''), '{SLUG}', 1), '#', 1), '(?i)^(musamman|tattaunawar_\w+|rukuni|oníṣe):|action=edit') as wiki_infra from apply_filters")
def rule_wiki_infra(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://ha.wikipedia.org/wiki/"), pick(NAMESPACES, "page_id"), F.regexp_extract(F.coalesce("url", F.lit("")), SLUG, 1))
    return _pages(spark, d).select("page_id", rules.wiki_infrastructure(url).alias("wiki_infra"))


LOCAL_LIST = "(" + ", ".join(f"'{h}'" for h in rules.LOCAL_HOSTS) + ")"


@query(rf"""with u as (select page_id, {site_sql(f'({RULE_URL})')} as h from apply_filters)
    select page_id, regexp_matches(h, '^(?:ha|ig|yo|hau|ibo|yor)\.') and not regexp_matches(h, '\.ng$|(^|\.)wikipedia\.org$') and regexp_replace(h, '^[^.]*\.', '') not in {LOCAL_LIST} as mt from u""")
def rule_mt_subdomain(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", rules.mt_subdomain(rule_url()).alias("mt"))


@query(rf"""with u as (select page_id, {site_sql(f'({RULE_URL})')} as h, {path_sql(f'({RULE_URL})')} as p from apply_filters)
    select page_id, regexp_matches(p, '(?i)^/(?:ha|ig|yo|hau|ibo|yor)(?:[-_][a-z]{{2,4}})?(?:/|$)') and not regexp_matches(h, '\.ng$|(^|\.)wikipedia\.org$') and h <> 'tool.com'
    and not list_has_any(['{"', '".join(rules.LOCAL_HOSTS)}'], list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.'))) as mt from u""")
def rule_mt_path(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", rules.mt_path(rule_url(), keep_hosts=("tool.com",)).alias("mt"))


@query(f"with u as (select page_id, {site_sql('url')} as h from apply_filters) select page_id, list_has_any({DROPPED_SQL}, {parents_sql('h')}) as blocked from u")
def blocked_host(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", rules.blocked(U.site(F.col("url")), F.array(*map(F.lit, DROPPED))).alias("blocked"))


@query(rf"select page_id, coalesce(regexp_matches({site_sql(f'({RULE_URL})')}, '(?i)^(?:[\w-]+\.)*wikipedia\.org$|^(?:[\w-]+\.)*jw\.org$|^(?:[\w-]+\.)*bible\w*\.\w+$|^(?:[\w-]+\.)*facebook\.\w+$'), false) as never, regexp_matches({dedup_url_sql(f'({RULE_URL})')} || '/', '/(tag|category|author|page)/') as listing from apply_filters")
def never_seed(spark: SparkSession, d: str) -> DataFrame:
    url = rule_url()
    return _pages(spark, d).select("page_id", rules.never_seed(U.site(url)).alias("never"), rules.listing(F.concat(url, F.lit("/x"))).alias("listing"))


def quality_sql(text: str) -> str:
    """The quality rules' first failing limit of ``t`` rows (…, w: words)."""
    lines = full_lines_sql(text)
    return rf"""case when not len(w) between 50 and 100000 then 'word_count'
    when not list_sum(list_transform(w, lambda x: length(x))) / len(w) between 3 and 10 then 'mean_word_length'
    when len(regexp_extract_all({text}, '#')) / len(w) > 0.1 or (len(regexp_extract_all({text}, '\.\.\.')) + len(regexp_extract_all({text}, '…'))) / len(w) > 0.1 then 'symbol_ratio'
    when len(list_filter({lines}, lambda l: l[1] in ('•', '-', '*', '·', '‣', '◦', '–'))) > 0.9 * len({lines}) then 'bullet_lines'
    when len(list_filter({lines}, lambda l: l like '%...' or l like '%…')) > 0.3 * len({lines}) then 'ellipsis_lines'
    when len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 0.8 * len(w) then 'alphabetic_words' end"""


@query(f"with t as (select page_id, wet_text, {words_sql('wet_text')} as w from apply_filters) select page_id, {quality_sql('coalesce(wet_text, chr(32))')} as why from t")
def rule_quality(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", rules.quality(F.coalesce("wet_text", F.lit(""))).alias("why"))


def repetition_sql(source: str, key: str, text: str) -> str:
    """(key, why): the repetition rules on ``source`` (key, text), by SQL: list statistics, then grams as rows."""
    lines = full_lines_sql("x")
    paras = rf"list_filter(list_transform(string_split_regex(coalesce(x, ''), '\n{WS}*\n'), lambda l: {strip_sql('l')}), lambda l: l <> '')"
    chars = lambda x: f"coalesce(list_sum(list_transform({x}, lambda l: length(l))), 0)"
    tops = " ".join(f"when n{n} > {limit} then 'top_{n}gram_chars'" for n, limit in rules.TOP_GRAMS)
    covers = " ".join(f"when n{n} > {limit} then 'dup_{n}gram_chars'" for n, limit in rules.COVERED_GRAMS)
    return f"""with r as (select distinct {key} as k, {text} as x, {words_sql(text)} as w from {source}),
    l as (select k, {lines} as ls, {paras} as ps from r),
    early as (select k, case when len(ls) > 0 and (len(ls) - len(list_distinct(ls))) / len(ls) > 0.30 then 'dup_line_fraction'
        when len(ps) > 0 and (len(ps) - len(list_distinct(ps))) / len(ps) > 0.30 then 'dup_paragraph_fraction'
        when {chars('ls')} > 0 and ({chars('ls')} - {chars('list_distinct(ls)')}) / {chars('ls')} > 0.20 then 'dup_line_chars'
        when {chars('ps')} > 0 and ({chars('ps')} - {chars('list_distinct(ps)')}) / {chars('ps')} > 0.20 then 'dup_paragraph_chars' end as why from l),
    total as (select k, greatest(list_sum(list_transform(w, lambda x: length(x))), 1) as chars from r where len(w) > 0),
    grams as (select k, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from r, (select unnest(range(2, 11)) as n) where len(w) >= n)),
    counted as (select k, n, g, count(*) as c, min(i) as first from grams group by 1, 2, 3),
    top as (select k, n, arg_min(c * length(replace(g, ' ', '')), (-c, first)) as part, max(c) as c from counted where n <= 4 group by 1, 2),
    again as (select distinct k, n, i + j as p from (select g.k, g.n, g.i from grams g join counted c on g.k = c.k and g.n = c.n and g.g = c.g where g.n >= 5 and c.c > 1 and g.i > c.first) x, (select unnest(range(0, 10)) as j) where j < n),
    cover as (select a.k, n, sum(length(w[p])) as part from again a join r on r.k = a.k group by 1, 2),
    shares as (select k, n, part / chars as s from (select k, n, case when c > 1 then part else 0 end as part from top union all select k, n, part from cover) join total using (k)),
    wide as (select k, {', '.join(f'max(case when n = {n} then s end) as n{n}' for n in range(2, 11))} from shares group by 1)
    select early.k as {key}, coalesce(why, case {tops} {covers} end) as why from early left join wide using (k)"""


@query(repetition_sql("apply_filters", "page_id", "wet_text"))
def rule_repetition(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("page_id", F.col("wet_text").alias("text")).distinct()
    return rules.with_repetition(pages).select("page_id", F.col("repetition").alias("why"))


EDGE_SQL = r"[.,;:!?\"''()\[\]“”‘’]"
STOP_SQL = "select lang, list_distinct(list(strip_accents(lower(word)))) as stop from stop_words where lang in ('hau_Latn', 'yor_Latn') group by 1"


def _stops(spark: SparkSession, d: str) -> DataFrame:
    return rules.stop_arrays(table(spark, d, "stop_words").where("lang in ('hau_Latn', 'yor_Latn')"))


@query(rf"""with s as ({STOP_SQL}) select page_id, len(list_filter(list_transform({words_sql('lower(strip_accents(coalesce(wet_text, chr(32))))')}, lambda x: regexp_replace(x, '^{EDGE_SQL}+|{EDGE_SQL}+$', '', 'g')), lambda x: list_contains(s.stop, x))) < 5 as few
    from apply_filters join s using (lang)""")
def rule_stopwords(spark: SparkSession, d: str) -> DataFrame:
    """Pages with fewer than five common words of their labelled language; the lists are one row a language."""
    return _pages(spark, d).join(_stops(spark, d), "lang").select("page_id", rules.few_stopwords(F.coalesce("wet_text", F.lit("")), F.col("stop")).alias("few"))


REASON_SQL = rf"""pages as (select distinct page_id, url, lang, wet_text, {words_sql('wet_text')} as w from apply_filters),
    s as ({STOP_SQL}), rep as ({repetition_sql('apply_filters', 'page_id', 'wet_text')}),
    q as (select *, {quality_sql('coalesce(wet_text, chr(32))')} as quality from pages),
    reasons as (select q.page_id, q.url, q.lang, coalesce('gopher_quality:' || quality, 'gopher_repetition:' || why,
        case when s.stop is not null and len(list_filter(list_transform({words_sql('lower(strip_accents(coalesce(wet_text, chr(32))))')}, lambda x: regexp_replace(x, '^{EDGE_SQL}+|{EDGE_SQL}+$', '', 'g')), lambda x: list_contains(s.stop, x))) < 5 then 'wura_stopwords' end) as reason
        from q left join rep using (page_id) left join s using (lang))"""


def reasoned(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("page_id", "url", "lang", F.coalesce("wet_text", F.lit("")).alias("text"), F.col("wet_text").isNull().alias("absent")).distinct().drop("absent")
    return rules.with_reason(pages, _stops(spark, d))


@query(f"with {REASON_SQL} select page_id, reason from reasons")
def filter_reason(spark: SparkSession, d: str) -> DataFrame:
    return reasoned(spark, d).select("page_id", "reason")


@query(f"with {REASON_SQL}, r as (select unnest([coalesce(lang, ''), 'all']) as lang, coalesce(split_part(reason, ':', 1), 'kept') as rule from reasons) select lang, rule, count(*) as n from r group by 1, 2")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.rule_counts(reasoned(spark, d))


# --- lines

LINES_CTE = f"""p as (select distinct page_id, {site_sql('url')} as host, coalesce(wet_text, '') as x from apply_filters),
    e as (select page_id, host, unnest({lines_sql('x')}) as raw, generate_subscripts({lines_sql('x')}, 1) as i from p),
    f as (select host, {strip_sql('raw')} as line, count(distinct page_id) as n_pages from e where {strip_sql('raw')} <> '' group by 1, 2)"""


def _hosted(spark: SparkSession, d: str) -> DataFrame:
    """A row for each page, whose copies are alike."""
    rows = _pages(spark, d).select("page_id", F.struct(U.site(F.col("url")).alias("host"), F.coalesce("wet_text", F.lit("")).alias("x")).alias("r"))
    return rows.groupBy("page_id").agg(F.min("r").alias("r")).select("page_id", "r.host", "r.x")


@query(f"with {LINES_CTE} select host, line, n_pages from f where n_pages >= 3")
def boiler_lines(spark: SparkSession, d: str) -> DataFrame:
    return B.host_lines(_hosted(spark, d), "page_id", "host", "x").where("n_pages >= 3")


@query(f"""with {LINES_CTE}, k as (select e.page_id, e.raw, e.i, {strip_sql('e.raw')} as line from e left join (select host, line from f where n_pages >= 3) b on e.host = b.host and {strip_sql('e.raw')} = b.line where b.line is null),
    t as (select page_id, arg_min(line, i) as title, min(i) as first from k group by 1),
    c as (select k.page_id, string_agg(raw, chr(10) order by k.i) as clean from k join t using (page_id) where k.i = first or k.line <> title group by 1)
    select p.page_id, md5(coalesce(clean, '')) as digest, length(coalesce(clean, '')) as n_chars from (select distinct page_id from p) p left join c using (page_id)""")
def boilerplate_strip(spark: SparkSession, d: str) -> DataFrame:
    return B.content(_hosted(spark, d), "page_id", "host", "x").select("page_id", F.md5("clean").alias("digest"), F.length("clean").cast("long").alias("n_chars"))


@query(f"""with p as (select distinct page_id, {site_sql('url')} as host, coalesce(wet_text, '') as x from apply_filters),
    e as (select page_id, host, unnest(string_split(x, chr(10))) as raw, generate_subscripts(string_split(x, chr(10)), 1) as i from p),
    f as (select host, {strip_sql('raw')} as line from (select distinct page_id, host, raw from e) group by 1, 2 having count(*) >= 20),
    c as (select e.page_id, string_agg(e.raw, chr(10) order by e.i) as body from e left join f on e.host = f.host and {strip_sql('e.raw')} = f.line where f.line is null group by 1)
    select p.page_id, md5(coalesce(body, '')) as digest, length(coalesce(body, '')) as n_chars from (select distinct page_id from p) p left join c using (page_id)""")
def body_strip(spark: SparkSession, d: str) -> DataFrame:
    return B.body(_hosted(spark, d), "page_id", "host", "x").select("page_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))


@query(rf"""with l as (select page_id, list_filter(string_split(coalesce(wet_text, ''), chr(10)), lambda x: {strip_sql('x')} <> '') as ls from apply_filters),
    u as (select page_id, case when ls[1] like '% - Wikipedia' then ls[2:] else ls end as ls from l),
    f as (select page_id, ls, list_position(list_transform(ls, lambda x: length(x) >= 100), true) as first from u)
    select page_id, md5(array_to_string(list_filter(case when first > 0 then ls[first:] else []::VARCHAR[] end, lambda x: not (regexp_matches(x, '{B.WIKI_LABEL}') or regexp_matches(x, '{B.WIKI_COORD}') or regexp_matches(x, '{B.WIKI_TOC}') or regexp_matches(x, '{B.WIKI_IMDB}') or regexp_matches(x, '{B.WIKI_FOOT}') or x like 'Lua error%' or x like 'Samfuri:%' or x like '[[Category%')), chr(10))) as digest from f""")
def wiki_strip(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.md5(B.without_furniture(F.coalesce("wet_text", F.lit("")))).alias("digest"))


BANNER_SQL = " or ".join(f"{strip_sql('x')} like '{b}%'" for b in BANNERS)


@query(f"select page_id, md5(array_to_string(list_filter(string_split(coalesce(wet_text, ''), chr(10)), lambda x: not ({BANNER_SQL})), chr(10))) as digest from apply_filters")
def banner_strip(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.md5(B.without_banners(F.coalesce("wet_text", F.lit("")), BANNERS)).alias("digest"))


def lid_sql(source: str, key: str, text: str) -> str:
    """CTEs up to ``lid`` (key, label, prob)."""
    return rf"""le as (select {key}, unnest(regexp_extract_all(lower(substr(coalesce({text}, ''), 1, 3000)), '[\p{{L}}\p{{N}}_\x{{0300}}-\x{{036F}}]+')) as w from {source}),
    lh as (select {key}, s.lang, count(*) as n from le join (select distinct lang, lower(word) as w from stop_words) s using (w) group by 1, 2),
    lt as (select {key}, arg_min(lang, (-n, lang)) as lang, max(n) as best, sum(n) as total from lh group by 1),
    lid as (select {source}.{key}, lt.lang as label, round(coalesce(best / total, 0), 4) as prob from {source} left join lt using ({key}))"""


@query(f"with {lid_sql('documents', 'doc_id', 'text')} select * from lid")
def lid(spark: SparkSession, d: str) -> DataFrame:
    """The default identifier over the documents; the prefix of its input is its definition."""
    return L.by_common_words(table(spark, d, "documents"), table(spark, d, "stop_words"), "doc_id", "text")


@query(f"""with p as (select page_id, min(lang) as lang, min(wet_text) as wet_text from apply_filters group by 1), {lid_sql('p', 'page_id', 'wet_text')}
    select coalesce(lang, '') as theirs, coalesce(label, '') as ours, count(*) as n from lid join p using (page_id) where substr(coalesce(lang, ''), 1, 3) <> substr(coalesce(label, ''), 1, 3) group by 1, 2""")
def lid_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The pages' labels against ours, where they differ."""
    pages = _pages(spark, d).groupBy("page_id").agg(F.min("lang").alias("lang"), F.min("wet_text").alias("wet_text"))
    ours = L.by_common_words(pages, table(spark, d, "stop_words"), "page_id", "wet_text")
    return L.confusion(pages.select("page_id", "lang").join(ours, "page_id"), "lang", "label")


@query(f"select page_id, length(x) as n_chars, b <> x and length(b) < 200 as banner_only from (select page_id, coalesce(wet_text, '') as x, array_to_string(list_filter(string_split(coalesce(wet_text, ''), chr(10)), lambda x: not ({BANNER_SQL})), chr(10)) as b from apply_filters)")
def banner_only(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are next to nothing without their banners."""
    text = F.coalesce("wet_text", F.lit(""))
    return _pages(spark, d).select("page_id", F.length(text).cast("long").alias("n_chars"), B.short_banners(text, BANNERS).alias("banner_only"))


LABELLED = """apply_filters as (select doc_id as page_id, min(url) as url, min(lang) as lang, min(text) as wet_text from build_label_dataset where doc_id is not null group by 1),
    kept as (select doc_id as page_id, (avg((label = 1)::INT) >= 0.5)::INT as keep from build_label_dataset where doc_id is not null and label is not null group by 1)"""


@query(f"""with {LABELLED}, {REASON_SQL},
    r as (select unnest([coalesce(r.lang, ''), 'all']) as lang, coalesce(reason, 'survivors') as reason, {site_sql('r.url')} as host, keep from reasons r join kept using (page_id)),
    g as (select lang, reason, count(*) as n, count(distinct host) as hosts, avg(keep) as rate from r group by 1, 2), b as (select lang, count(*) as n, avg(keep) as rate from r group by 1)
    select lang, reason, g.n, round(g.n / b.n, 6) as share, hosts, round(g.rate, 6) as keep_rate, g.rate > b.rate as above_base from g join b using (lang)""")
def rule_report(spark: SparkSession, d: str) -> DataFrame:
    """What each rule removes of the labelled documents, by language and over all: number, share, hosts, and how many of them people kept."""
    rows = table(spark, d, "build_label_dataset").where("doc_id is not null")
    docs = rows.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("url").alias("url"), F.min("lang").alias("lang"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    keep = rows.where("label is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.avg((F.col("label") == 1).cast("int")) >= 0.5).cast("int").alias("keep"))
    reasons = rules.with_reason(docs, _stops(spark, d)).select("page_id", "lang", "url", "reason")
    return reports.rule_report(reasons.join(keep, "page_id").withColumn("host", U.site(F.col("url"))))
