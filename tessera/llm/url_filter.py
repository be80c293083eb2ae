"""URL filters as a temporal list join.

Dated list entries (a pattern added to or removed from a list) become validity intervals, half open:
from an addition to the pattern's next entry. Captures are joined as of their fetch time: a capture's
URL gives the few keys it can match (its host, the domains above it, its path's prefixes down to the
depth that entries reach), and the join is an equality on key and month with the interval test on top.
So a key with a long history meets a capture only with the intervals of its month, and a host with
many captures is an ordinary skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import prepare, written


def host_of(url):
    """Lower-cased host of an absolute URL, without user, port and final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url):
    """Path of an absolute URL without query and fragment, '/' if empty."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): the intervals in which each pattern is on a list; until null: still.

    Of entries of one instant a removal wins; additions to what is on the list and removals of what isn't
    change nothing. Entries with a null in any column, or of another action or kind, are ignored.
    """
    known = entries.select("list", "kind", F.lower("pattern").alias("pattern"), "action", F.col("dated").cast("timestamp").alias("dated")).dropna()
    known = known.where("action in ('add', 'remove') and kind in ('host', 'domain', 'prefix')")
    one = known.groupBy("list", "kind", "pattern", "dated").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    order = Window.partitionBy("list", "kind", "pattern").orderBy("dated")
    changes = one.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    return changes.withColumn("until", F.lead("dated").over(order)).where("action = 'add'").select("list", "kind", "pattern", F.col("dated").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per capture (url, fetched_at): (columns to keep, as kept_<name>), url, fetched_at, host, blocked, rules.

    entries: (list, kind, pattern, action, dated). A host pattern matches the host, a domain pattern the
    host and all below it, a prefix pattern (host/path) that path and all below it at a '/'. rules are the
    sorted distinct 'list:kind:pattern' that were on a list at fetch time (since <= fetched_at < until).
    A null or relative URL, or a null fetch time: not blocked, no rules. Repeated rows give as many rows;
    empty tables give no rows, or nothing blocked. Other columns are ignored.
    """
    spark = captures.sparkSession
    prepare(spark)
    kept = tuple(f"`kept_{c}`" for c in keep)
    rows = captures.select(*(F.col(f"`{c}`").alias(f"kept_{c}") for c in keep), F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    rows = written(rows.withColumn("host", host_of(F.col("url"))).withColumn("uid", F.monotonically_increasing_id()), "captures")
    valid = written(validity(entries), "intervals")
    reach = valid.agg(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("depth")).first().depth or 0
    last = rows.agg(F.max("fetched_at").alias("t")).first().t
    month = lambda c: F.year(c) * 12 + F.month(c)

    asked = rows.where("host is not null and fetched_at is not null").select("uid", "fetched_at", "host", path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keys = F.concat(F.array(F.concat(F.lit("host:"), F.col("host"))), domains)
    if reach:
        parts = F.split(F.lower("path"), "/")
        steps = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(reach + 1)))
        keys = F.concat(keys, F.transform(steps, lambda i: F.concat(F.lit("prefix:"), F.col("host"), F.array_join(F.slice(parts, 1, i), "/"))))
    asked = asked.select("uid", "fetched_at", month(F.col("fetched_at")).alias("month"), F.explode(F.array_distinct(keys)).alias("key"))

    pattern = F.when(F.col("kind") == "prefix", F.regexp_replace("pattern", "/+$", "")).otherwise(F.regexp_replace("pattern", r"\.$", ""))
    held = valid.withColumn("key", F.concat("kind", F.lit(":"), pattern)).withColumn("rule", F.concat_ws(":", "list", "kind", "pattern"))
    held = held.where(F.col("since") <= F.lit(last)) if last else held.limit(0)
    end = F.least(F.coalesce("until", F.lit(last).cast("timestamp")), F.lit(last).cast("timestamp"))
    held = held.select("key", "rule", "since", "until", F.explode(F.sequence(month(F.col("since")), F.greatest(month(end), month(F.col("since"))))).alias("month"))

    hits = asked.join(held, ["key", "month"]).where("since <= fetched_at and (until is null or fetched_at < until)")
    rules = hits.groupBy("uid").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    out = rows.join(rules, "uid", "left")
    none = F.array().cast("array<string>")
    return out.select(*kept, "url", "fetched_at", "host", F.col("rules").isNotNull().alias("blocked"), F.coalesce("rules", none).alias("rules"))
