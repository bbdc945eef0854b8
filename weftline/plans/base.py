"""Registry of queries and their oracles, and the SQL fragments that several oracles share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def site_sql(url: str) -> str:
    return rf"regexp_replace(lower(split_part(regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':', 1)), '^www\.', '')"


def dedup_url_sql(url: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(split_part(coalesce({url}, ''), '#', 1), '^https?://(www\.)?', ''), '/+$', ''))"


def path_sql(url: str) -> str:
    return rf"regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(lower(nfc_normalize(coalesce({text}, ''))), '[\p{{L}}\p{{N}}_\x{{0300}}-\x{{036F}}]+')"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{WS}+'), lambda w: w <> '')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def lines_sql(text: str) -> str:
    """Python's splitlines of a text."""
    return f"(case when string_split_regex(coalesce({text}, ''), '{LINE_END}')[-1] = '' then string_split_regex(coalesce({text}, ''), '{LINE_END}')[:-2] else string_split_regex(coalesce({text}, ''), '{LINE_END}') end)"


def full_lines_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({text}, ''), '{LINE_END}'), lambda l: {strip_sql('l')}), lambda l: l <> '')"


def score_sql(key: str) -> str:
    """The deterministic stand-in for a classifier's score."""
    return f"round(('0x' || substr(md5({key}), 1, 4))::INT / 65535.0::DOUBLE, 4)"


def grams_sql(source: str, key: str, n: int) -> str:
    """Distinct (key, gram) from a table (key, w) of token lists."""
    return f"select distinct {key}, array_to_string(w[i:i + {n - 1}], ' ') as gram from (select {key}, w, unnest(range(1, len(w) - {n - 2})) as i from {source} where len(w) >= {n})"


DROPPED = ("gidan-labaru.example", "ng.example", "blog6.pulse-fenameyu.example", "shop.com")
DROPPED_SQL = "[" + ", ".join(f"'{h}'" for h in DROPPED) + "]"


def parents_sql(host: str) -> str:
    return f"list_transform(range(1, len(string_split({host}, '.')) + 1), lambda i: array_to_string(string_split({host}, '.')[i:], '.'))"


def pick(options: Sequence[str | None], key: str) -> Column:
    """One of several texts by a number's remainder: test urls for rules that the tables never trigger."""
    return F.element_at(F.array(*map(F.lit, options)), (F.col(key) % len(options) + 1).cast("int"))


def pick_sql(options: Sequence[str | None], key: str) -> str:
    return "[" + ", ".join("null" if o is None else "'" + o + "'" for o in options) + f"][({key} % {len(options)} + 1)::INT]"
