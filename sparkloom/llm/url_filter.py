"""Temporal URL lists: every capture meets the entries active when it was fetched.

Native DataFrame code.  A list is a log of dated changes, (pattern, category, action
``add`` or ``remove``, changed).  The last change of a day wins (``remove`` if a day
has both), and successive changes of a (pattern, category) become validity intervals
[from, to).  A pattern is a host, which covers its subdomains, or a host with path
segments, which covers everything below; it is normalised as captures are.

A capture asks for its host, every parent domain and every path prefix, down to the
deepest pattern of the list.  Captures are first reduced to distinct (pattern, day)
questions, so a host with a third of all pages is as many questions as it has days; an
as-of join finds the intervals that hold on that day; answers are joined back, the most
specific pattern first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import materialise

_FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; NULL if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    found = F.lower(F.regexp_replace(bare, r"\.$", ""))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    """Path segments without empty ones; query and fragment left out."""
    after = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.array_remove(F.split(after, "/"), "")


def questions(url: Column, segments: int) -> Column:
    """Patterns that would match: the host with its parents (at least two labels), and the host with 1..segments path segments."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    depth = F.least(F.size(p), F.lit(segments))
    paths = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(hosts, paths)))


def listed(pattern: Column) -> Column:
    """A list entry as captures ask for it: host and path segments; NULL if it has no host.

    Entries come with or without scheme, user, port, ``*.`` or a dot before the host, a
    dot behind it, in any case, and with any slashes; a query or fragment is left out.
    """
    bare = F.trim(pattern)
    url = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), bare).otherwise(F.concat(F.lit("http://"), F.regexp_replace(bare, "^/+", "")))
    name = F.regexp_replace(host(url), r"^(\*?\.)+", "")
    return F.when(name.rlike("[^*.]"), F.concat_ws("/", F.array(name), path(url)))


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to): when each entry was active.

    Rows with a NULL in any column are no change; entries that come to the same pattern
    are one entry, with the changes of all.
    """
    known = changes.select(listed(F.col("pattern").cast("string")).alias("pattern"), "category", "action", F.col("changed").cast("date").alias("changed")).dropna().where("action in ('add', 'remove')")
    daily = known.groupBy("pattern", "category", "changed").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    w = Window.partitionBy("pattern", "category").orderBy("changed")
    steps = daily.withColumn("valid_to", F.coalesce(F.lead("changed").over(w), F.lit(_FOREVER).cast("date")))
    return steps.where("action = 'add'").select("pattern", "category", F.col("changed").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """(id, host, fetched, blocked, pattern, category, valid_from): one row per capture.

    Of several active entries the longest pattern wins, then the first category.  A
    NULL or malformed URL has no host, a NULL date no active entry: both pass.
    Repeated captures are judged alike; empty tables are no special case.
    """
    active = materialise(intervals(changes), "intervals")
    segments = active.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(fetched_col).cast("date").alias("fetched"))
    asked = rows.select("id", host(F.col("url")).alias("host"), "fetched", questions(F.col("url"), segments).alias("patterns"))
    # one question set per (url patterns, day), answered once
    sets = materialise(asked.select("patterns", "fetched").dropna().distinct().withColumn("key", F.xxhash64("patterns")), "questions")
    each = sets.select(F.explode("patterns").alias("pattern"), "fetched").distinct()
    hit = each.join(active, "pattern").where("valid_from <= fetched and fetched < valid_to").groupBy("pattern", "fetched").agg(F.min(F.struct("category", "valid_from")).alias("entry"))
    best = sets.select("key", "patterns", "fetched", F.explode("patterns").alias("pattern")).join(hit, ["pattern", "fetched"]).groupBy("key", "patterns", "fetched").agg(
        F.max_by(F.struct("pattern", "entry"), F.struct(F.length("pattern"), "pattern")).alias("found"))
    best = best.select(F.col("patterns").alias("_p"), F.col("fetched").alias("_f"), "found")
    out = asked.join(best, (F.col("patterns") == F.col("_p")) & (F.col("fetched") == F.col("_f")), "left")
    return out.select(F.col("id").alias(id_col), "host", "fetched", F.col("found").isNotNull().alias("blocked"), F.col("found.pattern").alias("pattern"), F.col("found.entry.category").alias("category"), F.col("found.entry.valid_from").alias("valid_from"))
