"""Mixing sources to target weights by pivotal rounding, in DataFrame functions only.

Every document gets the fraction target / source size as its number of copies.
The whole part is certain; the fractional parts are rounded dependently: inside a
block two fractional documents meet, and words move at random from one to the
other until the copies of one of them are whole, and the other goes on.  A block
leaves one residual document, and blocks of residuals are reduced in turn, level
by level, until one is left for each source.  A meeting keeps both the expected
copies of each document and the words of the two, so only the last residual moves
a source off its target; blocks run from long to short, which leaves it small.

Defined results: null or empty text has size 0 and gets the whole part only; a null source is a source of its own, ranked last; rows that repeat
doc_id, source and size are rounded together and differ by at most one copy;
an empty table gives an empty result; further columns are ignored by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, is_small

BLOCK = 512
SMALL_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(cut) == 0, F.lit(0)).otherwise(F.size(F.split(cut, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), repeat_limit: float = 3.0) -> DataFrame:
    """(source, source_size, target) of sized(source, size).

    Sources in code point order take the weights in turn.  Targets share all words
    by weight; a target stops at `repeat_limit` times its source's size and what is
    over goes to the others by weight: sources sorted by the level at which they
    fill up, the full ones are a prefix of that order.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A row for each source from here on, so windows without a partition hold no more than that.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(repeat_limit)))
    fill, last = F.expr("most / weight"), F.col("source")
    before = Window.orderBy(fill, last.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(fill.desc(), last.desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    everything = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (everything - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("full"), F.struct(F.expr("most / weight"), F.col("level")))).over(Window.partitionBy())["level"]
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(open_level * F.col("weight")).alias("target"))


def _meeting(decided: str, v: int, holder: str, p: str) -> str:
    return f"named_struct('i', {holder}.i, 'p', greatest(0D, least(1D, {p})), 's', {holder}.s, 'done', concat(a.done, array(named_struct('i', {decided}.i, 'v', {v}))))"


# Holder a meets unit x. `up` words may move from x to a before one of them is whole, `down` words from a to x.
_FOLD = f"""
aggregate(units, named_struct('i', -1, 'p', 0D, 's', 0D, 'done', cast(array() as array<struct<i:int,v:int>>)), (a, x) ->
  CASE WHEN a.i < 0 THEN named_struct('i', x.i, 'p', x.p, 's', x.s, 'done', a.done) ELSE
  element_at(transform(array(named_struct('up', least((1 - a.p) * a.s, x.p * x.s), 'down', least(a.p * a.s, (1 - x.p) * x.s))), m ->
    CASE WHEN x.u * (m.up + m.down) < m.down THEN
      CASE WHEN (1 - a.p) * a.s <= x.p * x.s
      THEN {_meeting("a", 1, "x", "x.p - m.up / x.s")} ELSE {_meeting("x", 0, "a", "a.p + m.up / a.s")} END
    ELSE
      CASE WHEN a.p * a.s <= (1 - x.p) * x.s
      THEN {_meeting("a", 0, "x", "x.p + m.down / x.s")} ELSE {_meeting("x", 1, "a", "a.p - m.down / a.s")} END
    END), 1) END)
"""


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _round_level(rows: DataFrame, level: int, slots: int, seed: int) -> DataFrame:
    """Rows with p < 0 are decided (copies fixed); others meet within (source, slot)."""
    unit = F.struct("size", F.xxhash64(F.lit(seed), "doc_id", "size").alias("h"), "doc_id", "p", "whole", "m")
    slot = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size"), F.lit(slots))
    blocks = rows.groupBy("source", slot.alias("slot")).agg(F.sort_array(F.collect_list(unit), asc=False).alias("docs"))
    numbered = F.transform("docs", lambda d, i: F.struct(i.cast("int").alias("i"), d["p"].alias("p"), d["size"].cast("double").alias("s"), _uniform(F.lit(seed + 77 + level), d["h"], i).alias("u")))
    blocks = blocks.withColumn("units", numbered).withColumn("end", F.expr(_FOLD))
    decided = F.transform(F.col("end.done"), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"), F.lit(-1.0).alias("p")))
    left = F.array(F.struct(F.col("end.i").alias("i"), F.lit(0).alias("v"), F.col("end.p").alias("p")))
    flat = blocks.select("source", "docs", F.explode(F.concat(decided, left)).alias("e")).select("source", F.element_at("docs", F.col("e.i") + 1).alias("d"), "e")
    return flat.select("source", "d.doc_id", "d.size", "d.m", (F.col("d.whole") + F.col("e.v")).alias("whole"), F.col("e.p").alias("p"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), repeat_limit: float = 3.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(groups, targets) for docs(doc_id, text, source).

    groups has a row for each distinct (doc_id, source, size): m, the rows that
    share it, and copies, how often they are taken together.  The same seed gives
    the same copies, whatever the partitioning.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    targets = scratch.save(source_targets(sized, weights, repeat_limit), "targets")
    hot = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    side = F.broadcast(targets) if is_small(targets, SMALL_SOURCES) else targets
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    units = units.join(side.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    wanted = F.col("m") * F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(wanted + F.lit(1e-9))
    part = F.when((F.col("size") > 0) & (wanted - whole > 1e-9), wanted - whole).otherwise(F.lit(-1.0))
    units = scratch.save(units.select("source", "doc_id", "size", "m", whole.alias("whole"), part.alias("p")), "units")
    rows, done = units.where("p >= 0"), units.where("p < 0")
    slots, level = max(1, -(-hot // BLOCK)), 0
    while True:
        out = scratch.save(_round_level(rows, level, slots, seed), f"level{level}")
        done = done.unionByName(out.where("p < 0"))
        rows = out.where("p >= 0")
        if slots == 1:
            break
        slots, level = -(-slots // BLOCK), level + 1
    last = rows.withColumn("whole", F.col("whole") + (_uniform(F.lit(seed), F.col("doc_id"), F.col("size")) < F.col("p") - 1e-9).cast("long"))
    return done.unionByName(last).select("source", "doc_id", "size", "m", F.col("whole").alias("copies")), targets


def _share(i: Column) -> Column:
    """Copies of the i-th (from 1) of m rows that are taken `copies` times together."""
    return F.floor(F.col("copies") / F.col("m")) + (i <= F.col("copies") % F.col("m")).cast("long")


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken (words)."""
    groups, targets = mix(docs, **options)
    side = F.broadcast(targets) if is_small(targets, SMALL_SOURCES) else targets
    rows = groups.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("m")))).withColumn("_n", _share(F.col("_i")))
    rows = rows.join(side.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("_n").alias("copies"), (F.col("_n") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, all columns kept."""
    groups, _ = mix(docs, **options)
    groups = groups.where("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("src"), "size", "m", "copies")
    groups = Scratch(docs.sparkSession, "mix").save(groups, "groups")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so no name can clash
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("src")) & (word_count(F.col("row.text")) == F.col("size"))
    rows = rows.join(groups, same)
    i = F.row_number().over(Window.partitionBy("id", "src", "size").orderBy(F.xxhash64("row.text")))
    single = rows.where("m = 1").withColumn("n", F.col("copies"))
    tied = rows.where("m > 1").withColumn("i", i).withColumn("n", _share(F.col("i"))).drop("i")
    both = single.unionByName(tied).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return both.select("row.*")
