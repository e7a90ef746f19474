"""URL filters as a temporal list join; DataFrame functions only.

Dated list entries (a host pattern is added to or removed from a list on a day)
become validity intervals [valid_from, valid_to).  Each capture's host is expanded
to itself and its parent domains, joined to the intervals of those names, and the
interval that holds the fetch time is kept: an as-of join, as intervals of one
(list, name) never overlap.  The longest listed name decides; of equal names
``block`` beats ``allow``.

Captures are first reduced to distinct (host, fetch time), so a hot host that is
fetched again and again is evaluated once a time, and no group is gathered in one
task: the join may be split by Spark where a name is hot.

Defined cases: null, empty and host-less URLs have a null host and are not listed;
hosts compare in lower case without port, user or trailing dot; an entry that
repeats the state before it opens no interval; of a removal and an
addition at one moment the addition stands; a null fetch time meets no interval; repeated captures stay repeated;
an empty list leaves every capture unlisted; an empty table gives an empty result;
other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._spark import bitmap_filter, filter_bits, might_contain

FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]*\]|[^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def names_of(host: Column) -> Column:
    """The host and its parent domains, down to one label; an IP address has no parents."""
    address = host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    labels = F.split(host, r"\.")
    return F.when(address, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, name, action, op, at) -> (list, name, action, valid_from, valid_to).

    ``op`` is add or remove.  Changes of state alone bound intervals.
    """
    key = ["list", "name", "action"]
    w = Window.partitionBy(*key).orderBy("at", F.col("op").desc())
    # 'add' comes after 'remove' of the same moment, so it is the state that stands
    moments = entries.where(F.col("at").isNotNull() & F.col("name").isNotNull()).groupBy(*key, "at").agg(F.min("op").alias("op"))
    changes = moments.withColumn("was", F.lag("op").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("op")))
    bounded = changes.withColumn("valid_to", F.coalesce(F.lead("at").over(w), F.to_timestamp(F.lit(FOREVER))))
    return bounded.where("op = 'add'").select(*key, F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """page_id, host, fetched_at, action, matched_name, list, valid_from of every capture.

    action is null where nothing that was active at the fetch covers the host.
    """
    rows = captures.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), F.col(at).alias("fetched_at"))
    asked = rows.select("host", "fetched_at").where("host is not null and fetched_at is not null").distinct()
    named = asked.withColumn("name", F.explode(names_of(F.col("host"))))
    active = intervals(entries).withColumnRenamed("name", "listed")
    # names that no list has, as most top-level domains, go before anything is shuffled
    bits = filter_bits(active.count())
    named = might_contain(named, "name", bitmap_filter(active, "listed", bits), bits, "maybe").where("maybe").drop("maybe")
    held = named.join(active, (F.col("name") == F.col("listed")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_to"))).drop("listed", "valid_to")
    best = held.groupBy("host", "fetched_at").agg(
        F.max(F.struct(F.length("name").alias("length"), F.col("action"), "list", "name", "valid_from")).alias("best")
    )
    found = best.select("host", "fetched_at", F.col("best.action").alias("action"), F.col("best.name").alias("matched_name"), F.col("best.list").alias("list"), F.col("best.valid_from").alias("valid_from"))
    return rows.join(found, ["host", "fetched_at"], "left").select("page_id", "host", "fetched_at", "action", "matched_name", "list", "valid_from")
