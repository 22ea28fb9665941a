"""URL filtering against dated lists by an as-of join.

List entries are dated: an entry adds a host, domain or URL prefix to a list or
takes it off.  They become validity intervals, each lasting until the next entry
for the same list and pattern.  A capture is looked up under all its patterns, from
its top domain down to its full path, among the intervals valid at fetch time; the
most specific pattern decides, and a list that allows beats one that blocks there.

Defined results: a null or unparsable URL, or a null fetch time, matches nothing
and is kept; of entries for one list and pattern at one time, an addition beats a
removal; repeated captures are judged alike, each with its own row; empty lists keep
everything; an empty table gives an empty result; further columns pass through, those with
the names of the three results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fits

SMALL_BYTES = 32 << 20
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def patterns_of(url: Column) -> Column:
    """Suffixes of the host's labels, then the host with each prefix of its path's folders."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    folders = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    paths = F.when(F.size(folders) > 0, F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.concat_ws("/", host, F.array_join(F.slice(folders, 1, k), "/"))))
    return F.when(host.isNotNull(), F.concat(suffixes, F.coalesce(paths, F.filter(suffixes, lambda x: F.lit(False)))))


def intervals_of(entries: DataFrame) -> DataFrame:
    """(list, verdict, pattern, valid_from, valid_to) of entries(list, verdict, pattern, dated, action add or remove)."""
    order = Window.partitionBy("list", "pattern").orderBy("dated")
    once = entries.where("pattern is not null and dated is not null").groupBy("list", "pattern", "dated")
    once = once.agg(F.max(F.struct((F.col("action") == "add").alias("on"), "verdict")).alias("e"))
    dated = once.withColumn("valid_to", F.lead("dated").over(order)).where("e.on")
    return dated.select("list", F.col("e.verdict").alias("verdict"), "pattern", F.col("dated").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetched, ...) with matched_list, matched_pattern and blocked."""
    scratch = Scratch(captures.sparkSession, "urls")
    intervals = scratch.save(intervals_of(entries), "intervals")
    asked = captures.select(F.col("url").alias("_url"), F.col("fetched").alias("_fetched")).distinct()
    asked = asked.withColumn("_pattern", F.explode(patterns_of(F.col("_url"))))
    # Patterns that no list names, such as a frequent top domain, go before any shuffle where the names fit into a
    # broadcast, and before the join of intervals else.
    listed = scratch.save(intervals.select(F.col("pattern").alias("_listed")).distinct(), "listed")
    small = fits(listed, SMALL_BYTES)
    asked = asked.join(F.broadcast(listed) if small else listed, F.col("_pattern") == F.col("_listed"), "left_semi")
    side = F.broadcast(intervals) if fits(intervals, SMALL_BYTES) else intervals
    valid = (F.col("_pattern") == F.col("pattern")) & (F.col("_fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_fetched") < F.col("valid_to")))
    best = F.max(F.struct(F.length("pattern").alias("long"), (F.col("verdict") == "allow").alias("allow"), "pattern", "list"))
    found = asked.join(side, valid).groupBy("_url", "_fetched").agg(best.alias("_m"))
    found = scratch.save(found.select("_url", "_fetched", "_m.pattern", "_m.list", "_m.allow").toDF("_url", "_fetched", "_p", "_l", "_a"), "found")
    rows = captures.select(F.struct(*captures.columns).alias("row"))  # one column, so no name can clash
    rows = rows.join(found, (F.col("row.url") == F.col("_url")) & (F.col("row.fetched") == F.col("_fetched")), "left")
    own = [F.col(f"row.{c}") for c in captures.columns if c not in ("matched_list", "matched_pattern", "blocked")]
    return rows.select(*own, F.col("_l").alias("matched_list"), F.col("_p").alias("matched_pattern"), F.coalesce(~F.col("_a"), F.lit(False)).alias("blocked"))
