"""URL filters by a list whose entries are dated.

An entry adds or removes a pattern on a day: a domain (covers its subdomains), a host, or a host with a path prefix.
Entries become validity intervals; every capture is judged by the entries active on the day it was fetched, the longest
pattern first.

The join runs on (pattern, month): intervals are laid out over the months they cover, so captures of one host spread
over as many keys as the crawl has months, a key has few intervals however often a pattern was listed, and one
(url, day) is judged once however often it was captured. What is left of a hot key adaptive execution can split.

Results in edge cases: a url that is null or has no host matches nothing; without a fetch time nothing is active; on one
day a removal beats an addition; an addition while listed and a removal while not listed change nothing; an empty list
allows everything; repeated captures are each kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty without a scheme."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def lookups(url: Column) -> Column:
    """Every pattern that would cover a url: its host, the host's parents of two labels or more, and its path prefixes."""
    labels = F.split(host_of(url), r"\.")
    count = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, count), "."))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(parents, F.coalesce(paths, F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from (pattern, action, dated): half-open, without end while still listed.

    Entries of a pattern and day are folded before they are dealt out, so a pattern has a row per day at most.
    """
    days = entries.filter(F.col("pattern").isNotNull() & F.col("dated").isNotNull() & F.col("action").isin("add", "remove"))
    days = days.groupBy("pattern", "dated").agg(F.max(F.col("action") == "remove").alias("off"))
    by_day = W.partitionBy("pattern").orderBy("dated")
    changes = days.withColumn("was_off", F.coalesce(F.lag("off").over(by_day), F.lit(True))).filter("off <> was_off")
    spans = changes.withColumn("valid_to", F.lead("dated").over(by_day))
    return spans.filter("not off").select("pattern", F.col("dated").alias("valid_from"), "valid_to")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judge(captures: DataFrame, spans: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, pattern, valid_from and valid_to of the longest pattern active at fetch time."""
    named = captures.select(F.col(url).alias("__url"), F.to_date(fetched).alias("__day"))
    asked = named.filter("__url is not null and __day is not null").distinct()
    extent = asked.agg(F.min("__day").alias("lo"), F.max("__day").alias("hi"))
    keyed = asked.select("__url", "__day", _month(F.col("__day")).alias("month"), F.explode(lookups(F.col("__url"))).alias("pattern"))
    # One row of extent bounds the months an interval is laid out over.
    seen = spans.crossJoin(F.broadcast(extent)).filter("hi is not null and valid_from <= hi and (valid_to is null or valid_to > lo)")
    first = _month(F.greatest("valid_from", "lo"))
    last = _month(F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("hi")), F.col("hi")))
    laid = seen.filter(first <= last).select("pattern", "valid_from", "valid_to", F.explode(F.sequence(first, last)).alias("month"))
    active = keyed.join(laid, ["pattern", "month"]).filter("valid_from <= __day and (valid_to is null or __day < valid_to)")
    best = active.groupBy("__url", "__day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "valid_from", "valid_to")).alias("m"))
    best = best.select("__url", "__day", F.col("m.pattern").alias("pattern"), F.col("m.valid_from").alias("valid_from"), F.col("m.valid_to").alias("valid_to"))
    out = captures.join(best, (captures[url] == best["__url"]) & (F.to_date(captures[fetched]) == best["__day"]), "left")
    return out.select(*[captures[c] for c in captures.columns], best["pattern"].isNotNull().alias("blocked"), best["pattern"], best["valid_from"], best["valid_to"])
