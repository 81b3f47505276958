"""URL filters by a temporal list join.

A list is a feed of dated entries: on a day a host, a domain or a URL prefix was added to a list or taken
off it. Successive entries of a subject become intervals of validity. A capture is held against the entries
that were active when it was fetched: its host, each parent domain and each directory of its path are
looked up by equality, and the interval that holds the fetch time decides (the latest entry at or before
it). Exact hosts come before domains, longer domains before shorter ones; any active hit rejects.

Entries of a subject on one moment: the removal is taken last. Defined cases: captures with a null URL or
fetch time, or without a host, hit nothing. Entries with nulls are left out. Repeated captures are judged
alike; repeated entries count once. Empty captures give no rows, an empty list no hits. Other columns of
captures pass through, whatever their names; hits and kept replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

#: Intervals up to which the list is broadcast, in rows; a longer one is joined by shuffle.
BROADCAST_INTERVALS = 500_000


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$", ""), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def subjects(url: Column) -> Column:
    """All subjects that a URL can be listed under: host:h, domain:d for h and its parents, prefix:h/dir/."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    folders = F.split(F.regexp_replace(path_of(url), r"[^/]*$", ""), "/")
    depth = F.size(folders) - 2
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(2), depth + 1), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(folders, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(url.isNull() | (host == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (subject, category, day, added) as active intervals: subject, category, since, until (null: open)."""
    e = entries.select("subject", "category", F.col("day").cast("date").alias("day"), "added").dropna().groupBy("subject", "category", "day").agg(F.min("added").alias("added"))
    w = Window.partitionBy("subject", "category").orderBy("day")
    e = e.withColumns({"until": F.lead("day").over(w)})
    return e.where("added").select("subject", "category", F.col("day").alias("since"), "until")


def judge_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with hits (sorted list of category and subject that were active) and kept.

    Captures are looked up by subject and day, each once however often it was fetched, so a host that holds
    a third of all captures is a few rows; the join with the list is on subjects, the list being broadcast
    while it is short.
    """
    spans = cut(intervals(entries), "list-intervals")
    day, mark = free_name(captures, "_day"), free_name(captures, "_subjects")
    marked = captures.withColumns({day: F.col(fetched).cast("date"), mark: subjects(F.col(url))})
    asked = marked.select(F.col(day).alias("day"), F.explode(mark).alias("subject")).where("day IS NOT NULL").distinct()
    short = spans.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    listed = F.broadcast(spans) if short else spans
    active = asked.join(listed, "subject").where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    found = active.groupBy("day", "subject").agg(F.array_sort(F.collect_set(F.concat_ws("=", "category", "subject"))).alias("found"))
    # Hits go back to captures by their whole set of subjects and day, which few captures of a site share.
    sets = marked.select(F.col(day).alias("day"), F.col(mark).alias("set")).where("day IS NOT NULL").distinct()
    by_set = sets.select("day", "set", F.explode("set").alias("subject")).join(found, ["day", "subject"]).groupBy("day", "set").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("hits"))
    own = {name: free_name(captures, f"_found_{name}") for name in ("day", "set", "hits")}
    by_set = by_set.withColumnsRenamed(own)
    out = marked.join(by_set, (F.col(day) == F.col(own["day"])) & (F.col(mark) == F.col(own["set"])), "left")
    hits = F.coalesce(F.col(own["hits"]), F.array().cast("array<string>"))
    return out.withColumns({"hits": hits, "kept": F.size(hits) == 0}).drop(*own.values(), day, mark)
