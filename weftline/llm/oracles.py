"""SQL for those results of the subpackage that SQL can express: what must come out, not the method."""

from __future__ import annotations

HOST = r"nullif(regexp_replace(regexp_replace(regexp_replace(split_part(split_part(lower(trim({x})), '@', -1), ':', 1), '^\.+|[.\s]+$', '', 'g'), '^www\.', ''), '^\.+', ''), '')"
URL_HOST = HOST.format(x=r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)")
LABEL_HOST = HOST.format(x=r"regexp_replace(host, '^[A-Za-z][A-Za-z0-9+.-]*://|[/?#].*$', '', 'g')")

P2_FOUND = f"""with recursive r as (select distinct doc_id, coalesce(case when contains({LABEL_HOST}, '.') then {LABEL_HOST} end, {URL_HOST}) as h from build_label_dataset where trim(doc_id) <> ''),
    e as (select distinct a.h as x, b.h as y from r a join r b using (doc_id) where a.h <> b.h),
    w as (select x, y from e union select w.x, e.y from w join e on w.y = e.x)
    select distinct x as host_a, y as host_b from w where x < y"""

P2_MEMBERS = P2_FOUND.replace("select distinct x as host_a, y as host_b from w where x < y", "select x as host, least(x, min(y)) as first from w group by x")

P3_FOUND = rf"""with p as (select page_id, {URL_HOST} as h, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#][\s\S]*$', '', 'g'), '/+$', '') as path, string_split(coalesce(wet_text, ''), chr(10)) as ls from apply_filters),
    l as (select page_id, h, path, unnest(ls) as raw, generate_subscripts(ls, 1) - 1 as line_no from p where h is not null),
    k as (select page_id, h, path, line_no, regexp_replace(lower(nfc_normalize(raw)), '[^\p{{Lu}}\p{{Ll}}\p{{Lt}}\p{{Lo}}\p{{M}}]', '', 'g') as k from l where regexp_matches(raw, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}\p{{Lo}}]')),
    f as (select h, k from k group by 1, 2 having count(distinct path) >= 5)
    select distinct page_id, line_no::INT as line_no from k join f using (h, k)"""

P3_CTE = P3_FOUND[: P3_FOUND.rindex("select distinct")].rstrip()
P3_CLEAN = rf"""{P3_CTE}, lost as (select distinct page_id, line_no from k join f using (h, k)), g as (select page_id, list(line_no) as gone from lost group by 1), t as (select distinct page_id, wet_text from apply_filters)
    select page_id, case when gone is null then wet_text else array_to_string(list_filter(string_split(wet_text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as clean_text, coalesce(len(gone), 0)::INT as removed from t left join g using (page_id)"""
P3_LINES = rf"""{P3_CTE}, m as (select h, k, k.page_id, k.line_no, k.path, l.raw from k join f using (h, k) join l using (page_id, h, path, line_no)),
    s as (select h as host_name, trim(arg_min(raw, (page_id, line_no)), ' ') as line_text, count(distinct path) as pages, count(distinct raw) as variants from m group by h, k)
    select distinct * from s"""

P5_AGREEMENT = """with v as (select doc_id, lower(trim(annotator)) as a, arg_max(label, (coalesce(labelled_at, TIMESTAMP '1900-01-01'), label)) as label from build_label_dataset
        where lower(trim(coalesce(status, ''))) <> 'void' and label between 1 and 4 and doc_id is not null and trim(annotator) <> '' group by 1, 2),
    c as (select doc_id, count(*) as n, sum((label = 1)::INT) as c1, sum((label = 2)::INT) as c2, sum((label = 3)::INT) as c3, sum((label = 4)::INT) as c4 from v group by 1 having count(*) >= 2),
    s as (select count(*) as documents, sum(n) as votes, sum((c1 * (c1 - 1) + c2 * (c2 - 1) + c3 * (c3 - 1) + c4 * (c4 - 1)) / (n - 1)) as agree, sum(c1) as c1, sum(c2) as c2, sum(c3) as c3, sum(c4) as c4 from c),
    e as (select *, (c1 * (c1 - 1) + c2 * (c2 - 1) + c3 * (c3 - 1) + c4 * (c4 - 1)) / (votes - 1) as expected from s)
    select documents, votes::BIGINT as votes, round((agree - expected) / (votes - expected), 6) as alpha from e"""

FOLD = "list_filter(list_transform(string_split_regex(translate(strip_accents(lower(nfc_normalize(coalesce({x}, '')))), 'ɓɗƙƴ', 'bdky'), '[\\s\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{0b}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+'), lambda w: regexp_replace(w, '[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}\\p{{Lo}}\\p{{N}}]', '', 'g')), lambda w: w <> '')"
P8_FOUND = f"""with h as (select item_id, {FOLD.format(x='text')} as w from held_out), d as (select doc_id, {FOLD.format(x='text')} as w from documents),
    hs as (select item_id, w, least(len(w), 13) as n from h where len(w) > 0),
    hg as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from hs)),
    dg as (select distinct doc_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from hs) where len(w) >= n))
    select distinct doc_id, item_id from dg join hg using (n, g)"""

ORACLES = {"p2_found": P2_FOUND, "p2_members": P2_MEMBERS, "p3_found": P3_FOUND, "p3_clean": P3_CLEAN, "p3_lines": P3_LINES, "p5_agreement": P5_AGREEMENT, "p8_found": P8_FOUND}
