"""URL filters by dated lists: entries become validity intervals, captures are joined as of their fetch day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
REMOVE, NONE = "remove", "none"


def host_of(url: str) -> Column:
    """The host of a URL in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(F.col(url), HOST, 1))
    return F.when(host != "", host)


def registered_domain(host: str) -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.col(host), ".", -2)


def validity(entries: DataFrame) -> DataFrame:
    """(entry, since, until, action) from dated list changes (entry, day, seq, action).

    An entry holds from its day until the entry's next change; `until` is null for the last one. Of changes on one day
    the one of largest seq counts, so a key has at most one interval per calendar day, however many changes it saw.
    A removal ends an interval and starts none. Changes without entry or day are ignored.
    """
    daily = (entries.where("entry is not null and day is not null").groupBy("entry", "day")
             .agg(F.max(F.struct("seq", "action")).alias("last")))
    until = F.lead("day").over(Window.partitionBy("entry").orderBy("day"))
    return (daily.select("entry", F.col("day").alias("since"), until.alias("until"), F.col("last.action").alias("action"))
            .where(F.coalesce(F.col("action"), F.lit(REMOVE)) != REMOVE))


def verdicts(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url",
             fetched: str = "fetched") -> DataFrame:
    """One row per capture: the key, host, fetched, entry, since, verdict.

    The entries active on the fetch day whose name is the capture's host or a parent domain apply; the longest one
    decides. Without any the verdict is `none`, also for captures without host or day.

    Captures are reduced to the (name, day) pairs that occur before they meet the intervals, so a host or domain with a
    third of all captures has at most one pair per calendar day in the as-of join; each pair finds one interval at
    most, and the way back is a join on both columns. Repeated captures are judged alike; further columns are ignored;
    no captures give no rows, and no entries give `none`.
    """
    rows = captures.select(F.col(key).alias(key), host_of(url).alias("host"), F.col(fetched).alias("fetched"))
    visits = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = visits.select("host", "fetched", F.explode(parents).alias("entry"))
    asked = named.select("entry", "fetched").distinct()
    periods = validity(entries)
    active = (asked.join(periods, "entry")
              .where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
              .select("entry", "fetched", "since", "action"))
    decided = (named.join(active, ["entry", "fetched"]).groupBy("host", "fetched")
               .agg(F.max(F.struct(F.length("entry").alias("size"), "entry", "since", "action")).alias("best")))
    return (rows.join(decided, ["host", "fetched"], "left")
            .select(key, "host", "fetched", F.col("best.entry").alias("entry"), F.col("best.since").alias("since"),
                    F.coalesce("best.action", F.lit(NONE)).alias("verdict")))
