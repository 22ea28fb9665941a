"""Company and analyst snapshots: JSON of no fixed form, read as typed columns beside the open payload.

The payload is parsed once into a variant.  Known paths are taken from it by type; a path that
is missing, null or cannot be read as its type gives null and harms no other, and so does a payload that is
no JSON at all.  What nobody asked for stays in `rest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns by path and type; maps are keyed by period.
FIELDS = {
    "sector": ("$.info.sector", "string"),
    "beta": ("$.info.beta", "double"),
    "price": ("$.info.currentPrice", "double"),
    "shares": ("$.info.sharesOutstanding", "bigint"),
    "target_mean": ("$.analyst.targets.mean", "double"),
    "target_high": ("$.analyst.targets.high", "double"),
    "updown": ("$.analyst.updown", "struct<up: int, down: int>"),
    "eps_revisions": ("$.analyst.eps_revisions", "map<string, struct<up: int, down: int>>"),
    "growth": ("$.analyst.growth", "map<string, double>"),
    "earnings_date": ("$.analyst.calendar[0]", "date"),
}


def read_snapshots(rows: DataFrame, payload: str = "payload", fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """rows with `rest`, the payload as a variant, and a column for each of the fields."""
    parsed = rows.withColumn("rest", F.try_parse_json(F.col(payload))).drop(payload)
    return parsed.select("*", *[F.try_variant_get("rest", path, kind).alias(n) for n, (path, kind) in (fields or FIELDS).items()])


def net_revisions(revisions: Column) -> Column:
    """(up - down) / (up + down) over all periods of a map of revisions; null without any."""
    total = lambda k: F.aggregate(F.map_values(revisions), F.lit(0), lambda a, x: a + F.coalesce(x[k], F.lit(0)))
    return F.try_divide((total("up") - total("down")).cast("double"), (total("up") + total("down")).cast("double"))
