"""URL filters as a temporal list join, in DataFrame operations only.

A blocklist is a log of dated entries: at a time a domain or a URL prefix is put on a list or taken off it. The log's
entries of one key and list become validity intervals [from, to), one row per key with its intervals as a short array.
A capture is blocked if an entry for its host, a parent domain of it, or a path prefix on its host was active when it was
fetched: an as-of join by equality on the key, then a test of the key's intervals. A capture's keys are its host's
suffixes and its path's prefixes by segment, as deep as the deepest entry of the list goes.

Captures are expanded to keys once. A short list is broadcast, so that no key is shuffled; with a long one the keys that very
many captures ask for, a top-level domain's or a hot host's, are broadcast and only the others shuffled.

Defined cases: a null or hostless URL has no keys and is never blocked; a null fetch time is before every entry. Of
entries of one key, list and time, a removal counts last. Adding twice extends one interval. Host names are compared in
lower case without ``www.``, a port or credentials; repeated captures give repeated rows. Empty lists block
nothing, an empty capture table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictbefore.llm.common import materialise

#: Keys of a list that is broadcast whole; a key's row is some hundred bytes.
LIST_ROWS = 200_000
#: A key that more than a COMMON-th of all expanded captures ask for is hot.
COMMON = 1000


def host_of(url: Column) -> Column:
    """The host in lower case without credentials, port and ``www.``; null if there is none."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(rest), r"^www\.|\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path from its first slash, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)


def keys_of(host: Column, path: Column, deepest: int) -> Column:
    """The host with its parent domains, then host and path prefixes by segment; null without a host."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    depth = F.least(F.size(segments), F.lit(deepest))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(domains, prefixes))


def intervals(entries: DataFrame, key_col: str = "key", list_col: str = "list", at_col: str = "at", added_col: str = "added") -> DataFrame:
    """One row per key: key, and spans array<struct<list, from, to>>; an open end is null."""
    log = entries.select(entries[key_col].alias("key"), entries[list_col].alias("list"), entries[at_col].cast("timestamp").alias("at"), entries[added_col].alias("added"))
    log = log.filter("key is not null and at is not null and added is not null")
    # the last word at each instant, then the instants at which the state turns
    log = log.groupBy("key", "list", "at").agg(F.min("added").alias("added"))
    order = Window.partitionBy("key", "list").orderBy("at")
    turns = log.withColumn("was", F.lag("added", 1, False).over(order)).filter("added != was")
    spans = turns.withColumn("to", F.lead("at").over(order)).filter("added")
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("list", F.col("at").alias("from"), "to"))).alias("spans"))


def on_list(keyed: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is listed, with the key's spans.

    A list of up to LIST_ROWS keys is broadcast. A longer one is shuffled by key, all but the keys that a COMMON-th of all
    rows or more ask for, such as a top-level domain: there are at most COMMON of these a level, and they are broadcast.
    """
    if listed.count() <= LIST_ROWS:
        return keyed.join(F.broadcast(listed), "key")
    asked = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")), "asked-keys")
    total = asked.agg(F.sum("n")).first()[0] or 0
    hot = asked.filter(F.col("n") * COMMON >= total).select("key")
    often = listed.join(F.broadcast(hot), "key", "left_semi")
    seldom = listed.join(F.broadcast(hot), "key", "left_anti")
    rest = keyed.join(F.broadcast(hot), "key", "left_anti")
    return keyed.join(F.broadcast(often), "key").unionByName(rest.join(seldom.hint("merge"), "key"))


def evaluate(captures: DataFrame, listed: DataFrame, id_col: str, url_col: str, at_col: str) -> DataFrame:
    """One row per capture: id, url, fetched, host, blocked, lists (names in order), key (the most general that matched)."""
    rows = captures.select(
        F.monotonically_increasing_id().alias("row"), captures[id_col].alias("id"), captures[url_col].alias("url"), captures[at_col].cast("timestamp").alias("fetched"), host_of(captures[url_col]).alias("host")
    )
    listed = materialise(listed, "listed")
    deepest = listed.agg(F.max(F.size(F.split("key", "/")))).first()[0] or 1
    found_keys = keys_of(F.col("host"), path_of(F.col("url")), deepest - 1)
    keyed = rows.select("url", "fetched", F.posexplode(found_keys).alias("level", "key"))
    inside = lambda s: (s["from"] <= F.col("fetched")) & (s["to"].isNull() | (F.col("fetched") < s["to"]))
    lists = F.array_distinct(F.transform(F.filter("spans", inside), lambda s: s["list"]))
    hits = on_list(keyed, listed).withColumn("lists", lists).filter(F.size("lists") > 0)
    # captures that repeat are made one where few rows are left, so that a hot page is one row
    hits = hits.groupBy("url", "fetched", "level", "key").agg(F.first("lists").alias("lists"))
    found = hits.groupBy("url", "fetched").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"), F.min_by("key", "level").alias("key"))
    found = found.select(F.col("url").alias("_url"), F.col("fetched").alias("_fetched"), "lists", "key")
    out = rows.join(found, (rows["url"] == found["_url"]) & (rows["fetched"] == found["_fetched"]), "left")
    return out.select("id", "url", "fetched", "host", F.col("key").isNotNull().alias("blocked"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), "key")
