"""URL expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _clean_host(authority: Column) -> Column:
    """Lower case, without user, port, leading ``www.`` and outer dots; null if nothing is left."""
    bare = F.substring_index(F.substring_index(F.lower(F.trim(authority)), "@", -1), ":", 1)
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\.+|[.\s]+$", ""), r"^www\.", "")
    bare = F.regexp_replace(bare, r"^\.+", "")
    return F.when(bare != "", bare)


def host_name(url: Column) -> Column:
    """Host of an absolute url (``https://WWW.A.example:443/x`` gives ``a.example``), null without one."""
    return _clean_host(F.regexp_extract(url, AUTHORITY, 1))


def host_label(host: Column) -> Column:
    """A host column's value in the same form; null for placeholders, which have no dot."""
    clean = _clean_host(F.regexp_replace(host, r"^[A-Za-z][A-Za-z0-9+.-]*://|[/?#].*$", ""))
    return F.when(clean.contains("."), clean)


def url_path(url: Column) -> Column:
    """Path of a url without query, fragment and trailing slashes."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#][\s\S]*$", "")
    return F.regexp_replace(rest, "/+$", "")


def site(url: Column) -> Column:
    """Authority before the first colon, lower case, without one leading ``www.``; user information stays. '' without one."""
    return F.regexp_replace(F.lower(F.split_part(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1), F.lit(":"), F.lit(1))), r"^www\.", "")


def dedup_url(url: Column) -> Column:
    """The form in which urls are compared: no fragment, scheme, ``www.`` or trailing slashes; lower case; the query stays."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(F.coalesce(url, F.lit("")), "#", 1), r"^https?://(www\.)?", ""), "/+$", ""))


def url_id(url: Column) -> Column:
    """First 16 digits of sha1."""
    return F.substring(F.sha1(url), 1, 16)


def raw_path(url: Column) -> Column:
    """Path of an absolute url, with its slashes."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_query(url: Column) -> Column:
    """Path, ``?`` and query (``?`` also without a query)."""
    return F.concat(raw_path(url), F.lit("?"), F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1))


def parents(host: Column) -> Column:
    """A host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def same_host(url: Column, host: Column) -> Column:
    """The url's authority, without ``www.``, is the host; or it is a path from the root."""
    own = F.regexp_replace(F.lower(F.coalesce(F.nullif(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), F.regexp_extract(url, "^//([^/?#]*)", 1))), r"^www\.", "")
    return (own == host) | ((own == "") & url.startswith("/"))
