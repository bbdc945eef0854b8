"""Line rules over a whole crawl: lines counted by host, page furniture, banners.

Lines are counted by a 64-bit hash of their stripped text: what is shuffled for the counts is (host, hash), map-side
combined. A page's text is moved once, to meet the numbers of the lines that it loses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import let, lines, strip

# fixed values: wiki page furniture
WIKI_LABEL = r"\((en|mul|fr|de|es|ar)\)"
WIKI_COORD = r"\d+°\d*|°[NSEW]\b|\d+\.\d+°[NSEW]"
WIKI_TOC = r"^(\d+(\.\d+)*\s|Toggle\s)"
WIKI_IMDB = r"^nm\d{5,}$|^tt\d{5,}$"
WIKI_FOOT = r'^(Daga "https?://|Anyi gyaran ƙarshe|↑ )'
WIKI_PREFIXES = ("Lua error", "Samfuri:", "[[Category")
SENTENCE = 100  # characters of a wiki page's first real line


def host_lines(pages: DataFrame, page: str, host: str, text: str) -> DataFrame:
    """(host, line, n_pages): on how many pages of its host each stripped line stands; counted map-side first."""
    each = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(lines(F.col(text)), strip))).alias("line")).where("line != ''")
    return each.groupBy("host", "line").agg(F.count("*").alias("n_pages"))


def _without_frequent(pages: DataFrame, page: str, host: str, text: str, split: Callable[[Column], Column], least: int, blank: bool) -> DataFrame:
    """(page, kept): the lines of each page that don't stand on ``least`` or more pages of its host.

    ``pages`` has one row a page. ``blank``: lines are told apart before they are stripped, and blank ones count, too.
    """
    keyed = F.transform(F.array_distinct(split(F.col(text))), lambda x: F.xxhash64(strip(x))) if blank else F.array_distinct(F.transform(split(F.col(text)), lambda x: F.xxhash64(strip(x))))
    empty = F.xxhash64(F.lit(""))
    counted = pages.select(F.col(host).alias("host"), F.explode(keyed).alias("key"))
    counted = counted if blank else counted.where(F.col("key") != empty)
    frequent = counted.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("host", "key")
    places = pages.select(page, F.col(host).alias("host"), F.posexplode(F.transform(split(F.col(text)), lambda x: F.xxhash64(strip(x)))).alias("i", "key"))
    lost = places.join(frequent, ["host", "key"], "left_semi").groupBy(page).agg(F.collect_list("i").alias("lost"))
    joined = pages.select(page, F.col(text).alias("_text")).join(lost, page, "left")
    kept = F.filter(split(F.col("_text")), lambda x, i: ~F.coalesce(F.array_contains("lost", i), F.lit(False)))
    return joined.select(page, kept.alias("kept"))


def content(pages: DataFrame, page: str, host: str, text: str, least: int = 3) -> DataFrame:
    """(page, clean): lines on ``least`` or more pages of the host are dropped, and later copies of the first line left (the title).

    One row a page; a null text or one without lines gives an empty one.
    """
    kept = _without_frequent(pages, page, host, text, lines, least, blank=False)
    title = lambda k: strip(F.try_element_at(k, F.lit(1)))
    rest = let(F.col("kept"), lambda k: let(title(k), lambda t: F.filter(k, lambda x, i: (i == 0) | (strip(x) != t))))
    return kept.select(page, F.coalesce(F.array_join(rest, "\n"), F.lit("")).alias("clean"))


def body(pages: DataFrame, page: str, host: str, text: str, least: int = 20) -> DataFrame:
    """(page, body): newline-split lines without those on ``least`` or more pages of the host, blank lines counted too; one row a page."""
    kept = _without_frequent(pages, page, host, text, lambda t: F.split(t, "\n", -1), least, blank=True)
    return kept.select(page, F.coalesce(F.array_join("kept", "\n"), F.lit("")).alias("body"))


def without_furniture(text: Column) -> Column:
    """A wiki page from its first line of SENTENCE characters on, without labels, coordinates, contents and footers."""
    titled = lambda full: F.coalesce(F.try_element_at(full, F.lit(1)).endswith(" - Wikipedia"), F.lit(False)).cast("int")
    odd = lambda x: x.rlike("|".join(f"(?:{p})" for p in (WIKI_LABEL, WIKI_COORD, WIKI_TOC, WIKI_IMDB, WIKI_FOOT))) | starts(x, WIKI_PREFIXES)
    # the first long line after the title, and what follows it
    long = lambda full, skip: F.array_min(F.filter(F.transform(full, lambda x, i: F.when((F.length(x) >= SENTENCE) & (i >= skip), i)), lambda i: i.isNotNull()))
    told = lambda full: let(long(full, titled(full)), lambda first: F.filter(full, lambda x, i: (i >= first) & ~odd(x)))
    full = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    return let(full, lambda full: F.array_join(told(full), "\n"))


def starts(x: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def without_banners(text: Column, banners: Sequence[str]) -> Column:
    """Newline-split lines that don't start, stripped, with a banner."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~starts(strip(x), banners)), "\n")


def short_banners(text: Column, banners: Sequence[str], least: int = 200) -> Column:
    """Whether a page that has banners is under ``least`` characters without them."""
    rest = without_banners(text, banners)
    return (rest != text) & (F.length(rest) < least)
