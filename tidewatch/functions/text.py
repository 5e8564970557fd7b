"""Links, handles, search text and page previews."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.values import as_col

# Handle shape, markers of each link kind, and the preview's count patterns.
HANDLE_IN_LINK = r"(?:t\.me/|telegram\.me/|@)([A-Za-z0-9_]{4,32})"
BARE_HANDLE = r"^[A-Za-z0-9_]{4,32}$"
TELEGRAM_MARKS = ("t.me", "telegram")
X_MARKS = ("twitter.com", "x.com", "twitter")
COUNT_MEMBERS = r"(?i)([\d\s,  ]+)\s+(?:members|subscribers)"
COUNT_ONLINE = r"(?i)([\d\s,  ]+)\s+online"


def has_any(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether the text holds any of the marks, in one scan."""
    return text.rlike("|".join(re.escape(m) for m in marks))


def link_items(entries: Column) -> Column:
    """Link list (text or JSON objects as text) to array<struct<url, kind>>.

    Telegram is tested first, then X, then any web address.
    """

    def read(e: Column) -> Column:
        is_object = F.trim(e).startswith("{")
        parsed = F.from_json(F.when(is_object, e), "struct<url:string,type:string,label:string>")
        return F.struct(parsed.alias("o"), F.when(~is_object, e).alias("plain"))

    def named(r: Column) -> Column:
        o = r["o"]
        tag = F.coalesce(F.nullif(o["type"], F.lit("")), F.nullif(o["label"], F.lit("")), F.lit(""))
        url = F.coalesce(r["plain"], o["url"], F.lit(""))
        return F.struct(url.alias("url"), F.lower(F.concat_ws(" ", tag, url)).alias("blob"))

    def judged(n: Column) -> Column:
        kind = (
            F.when(has_any(n["blob"], TELEGRAM_MARKS), "telegram")
            .when(has_any(n["blob"], X_MARKS), "x")
            .when(n["url"].startswith("http"), "website")
        )
        return F.struct(n["url"].alias("url"), kind.alias("kind"))

    # One pass per step, so the JSON of an entry is parsed once.
    return F.transform(F.transform(F.transform(entries, read), named), judged)


def declares(items: Column, kind: str) -> Column:
    """Whether the list declares this kind; null for no list."""
    return F.exists(items, lambda i: i["kind"].eqNullSafe(kind))


def first_url(items: Column, kind: str) -> Column:
    hits = F.filter(items, lambda i: i["kind"].eqNullSafe(kind) & (i["url"] != ""))
    return F.get(hits, F.lit(0))["url"]


def declared_in_uri(uri: Column | str) -> Column:
    """struct<telegram, x, website> read off one metadata URI; null when there is none."""
    u = F.lower(as_col(uri))
    return F.when(
        F.length(u) > 0,
        F.struct(
            has_any(u, ("t.me", "telegram")).alias("telegram"),
            has_any(u, ("twitter.com", "x.com")).alias("x"),
            u.contains("http").alias("website"),
        ),
    )


def handle(c: Column | str) -> Column:
    """Channel handle from a URL, an @mention or bare text."""
    c = as_col(c)
    linked = F.regexp_extract(c, HANDLE_IN_LINK, 1)
    bare = F.regexp_replace(F.trim(c), "^@+", "")
    return F.when(linked != "", linked).when(bare.rlike(BARE_HANDLE), bare)


def search_query(ticker: Column | str, contract: Column | str) -> Column:
    """Search text for a token, without reposts; null when there is nothing to search for."""
    t, c = F.nullif(as_col(ticker), F.lit("")), F.nullif(as_col(contract), F.lit(""))
    tag = F.when(t.startswith("$"), t).otherwise(F.concat(F.lit("$"), t))
    terms = F.concat_ws(" OR ", tag, c)
    return F.when(terms != "", F.concat(F.lit("("), terms, F.lit(") -is:retweet")))


def shown_count(html: Column, pattern: str) -> Column:
    digits = F.regexp_replace(F.regexp_extract(html, pattern, 1), "[^0-9]", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def preview(html: Column | str) -> Column:
    """struct<exists, members, online> of a public channel preview page."""
    h = as_col(html)
    there = h.contains("tgme_page") | h.contains("tgme_channel_info")
    return F.struct(
        there.alias("exists"),
        F.when(there, shown_count(h, COUNT_MEMBERS)).alias("members"),
        F.when(there, shown_count(h, COUNT_ONLINE)).alias("online"),
    )


def seen_fields(facts: Column, source: str) -> Column:
    """Sorted "source:key" names of a map of raw values, one level into objects."""

    def inner(e: Column) -> Column:
        v = F.trim(e["value"])
        name = F.concat(F.lit(f"{source}:"), e["key"])
        obj = F.json_object_keys(F.when(v.startswith("{"), v))
        items = F.from_json(F.when(v.startswith("["), v), "array<string>")
        first_obj = F.get(F.filter(items, lambda x: F.trim(x).startswith("{")), F.lit(0))
        listed = F.json_object_keys(first_obj)
        none = F.array().cast("array<string>")
        return F.concat(
            F.array(name),
            F.coalesce(F.transform(obj, lambda k: F.concat(name, F.lit("."), k)), none),
            F.coalesce(F.transform(listed, lambda k: F.concat(name, F.lit("[]."), k)), none),
        )

    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.map_entries(facts), inner))))
