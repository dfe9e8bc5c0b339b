"""URL filters: dated list entries become validity intervals, every capture meets the entries active when it was fetched.

A list entry names a key: a host, a parent domain, or a host with the first segments of a path, any number of them.
`add` and `remove` entries of a key take turns; of entries of one list, key and day the removal counts. A capture matches the entries of
all its keys whose interval holds its day. It is blocked if a matching entry of a blocking list is more specific (its
key is longer) than every matching entry of an allowing list.

Every capture comes back once: a null or malformed url, or a null day, matches nothing. Captures equal in id, url and day
count as one; ties don't matter, as matches and lists are sets. Empty tables give empty results or no matches, columns
other than the named ones are ignored. Captures of any number meet list entries of any number by key and date; both
sides of that join are plain shuffles, so that adaptive execution splits the captures of a frequent key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The longest name that the domain name system allows; a longer host has no parent domains.
HOST_CHARS = 253
#: A host may be an address in brackets.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"
ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def host(url: Column) -> Column:
    """The host in lower case and without the root's dot, "" where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"\.$", "")


def segments(url: Column) -> Column:
    """The path's segments without empty ones; query and fragment are no part of it."""
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda s: s != "")


def keys_of(of: Column, parts: Column) -> Column:
    """All keys of a host and the segments of a path; an address has no parent domains."""
    labels = F.split(of, r"\.")
    whole = (F.length(of) > HOST_CHARS) | (F.size(labels) < 2) | of.rlike(ADDRESS)
    domains = F.when(whole, F.array(of)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda j: F.concat(of, F.lit("/"), F.array_join(F.slice(parts, 1, j), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(of == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def keys(url: Column) -> Column:
    """All keys that entries for this url can have."""
    return keys_of(host(url), segments(url))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, since, until) from entries (key, list, action, day); until is exclusive, null while an entry stands.

    An interval ends with the next entry of its key, so intervals of a key don't overlap.
    """
    daily = entries.where("key IS NOT NULL AND list IS NOT NULL AND day IS NOT NULL").groupBy("key", "list", "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    until = F.lead("day").over(Window.partitionBy("key", "list").orderBy("day"))
    return daily.withColumn("until", until).where("removed = 0").select("key", "list", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, active: DataFrame, allowing: tuple[str, ...] = ("allow",)) -> DataFrame:
    """(id, host, n_active, lists, blocked) for captures (id, url, day) against intervals (key, list, since, until).

    Keys deeper than any entry can match nothing and aren't made.
    """
    active = stored(active.select("key", "list", "since", "until"), "intervals")
    deepest = active.agg(F.coalesce(F.max(F.size(F.split("key", "/")) - 1), F.lit(0)).alias("depth")).first()["depth"]
    parts = captures.select("id", "url", "day", host(F.col("url")).alias("host"), F.slice(segments(F.col("url")), 1, deepest).alias("parts"))
    by_key = parts.select("id", "url", "day", F.explode_outer(keys_of(F.col("host"), F.col("parts"))).alias("key")).alias("c")
    holds = (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    joined = by_key.join(active.alias("a"), (F.col("c.key") == F.col("a.key")) & holds, "left")
    hits = joined.groupBy("id", "url", "day").agg(F.collect_set(F.when(F.col("list").isNotNull(), F.struct(F.col("a.key").alias("key"), "list"))).alias("hits"))
    longest = lambda which: F.coalesce(F.array_max(F.transform(F.filter("hits", which), lambda h: F.length(h["key"]))), F.lit(0))
    blocked = longest(lambda h: ~h["list"].isin(*allowing)) > longest(lambda h: h["list"].isin(*allowing))
    return hits.select("id", host(F.col("url")).alias("host"), F.size("hits").cast("long").alias("n_active"), F.array_join(F.array_sort(F.array_distinct("hits.list")), ",").alias("lists"), blocked.alias("blocked"))
