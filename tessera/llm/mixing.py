"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates are the closest to 1 in relative entropy under one word constraint a source:
the words taken equal the source's target. Their dual is convex, with one multiplier a
source, and its solution tilts exponentially by size: rate = min(most, exp(lambda * size / mean
size of the source)). Newton steps, kept inside a bracket, solve it over the histogram of
(source, size). Rates are then rounded into copies along the documents of a source ordered by
size, so that copies and rates never part by more than one document.

Targets: sources by code point, null last, weigh ``weights`` in turn and share all words; a
target stops at ``most`` times its source's words, the excess reshared by weight until none
is above (water-filling, in closed form).

Plan: one pass over the texts keeps (doc_id, source, size). All that follows works on
histograms summed before they are shuffled: (source, size) for rates, and (source, size, salt)
for the place of a document within its size, so no task holds a hot source. Sums are of
integers (rates in units of 2**-20): reruns agree to the last copy.

Defined cases: null and empty texts have size 0 and take nothing; a null source is a source;
repeated rows are documents each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import keep

WORD = r"[^\x20\x09-\x0D]+"
_UNIT = 1 << 20
_SALTED = 1000  # documents of one source and size that share a salt, about


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds sr (rank, from 0), weight and target to ``sources(source, docs, words)``."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("sr") % len(weights) + 1).cast("int"))
    s = sources.withColumn("sr", (F.row_number().over(by_name) - 1).cast("int")).withColumn("weight", pick.cast("double"))
    s = s.withColumn("cap", most * F.col("words").cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "sr")
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("words").over(everything).cast("double") - before) / after)
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "sr", "level"))).over(everything)["level"]
    return s.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).drop("cap", "fill", "level")


def _rate(lam: str, size: str, mean: str, most: int):
    """Rate in units of 2**-20, a long."""
    tilt = F.least(F.col(lam) * F.col(size) / F.col(mean), F.lit(2.0))
    return F.round(F.least(F.exp(tilt), F.lit(float(most))) * _UNIT).cast("long")


def solve(cells: DataFrame, sources: DataFrame, most: int = 3, steps: int = 40, near: float = 1e-5) -> DataFrame:
    """(sr, lam, mean) whose tilted rates over ``cells(sr, size, n)`` take each source's target."""
    state = sources.select("sr", "target", (F.col("words") / F.greatest("docs", F.lit(1))).alias("mean"), F.col("words")).where("words > 0")
    capped = F.col("target") >= most * F.col("words")
    state = state.withColumn("lam", F.when(capped, 1e6).otherwise(F.log(F.col("target") / F.col("words"))))
    state = state.withColumns({"lo": F.when(capped, 1e6).otherwise(-1e6), "hi": F.lit(1e6), "done": capped})
    state = keep(state.coalesce(1), "multipliers")
    for _ in range(steps):
        r = _rate("lam", "size", "mean", most)
        part = F.col("n") * F.col("size")
        inside = F.when(r < most * _UNIT, r).otherwise(0)
        sums = cells.join(state.where("not done"), "sr").groupBy("sr").agg(
            F.sum((part * r).cast("decimal(38,0)")).alias("got"), F.sum((part * F.floor(F.col("size") * inside / F.col("mean"))).cast("decimal(38,0)")).alias("slope")
        )
        gap = F.col("got").cast("double") / _UNIT - F.col("target")
        s = state.join(sums, "sr", "left").withColumn("gap", F.when(F.col("done"), 0.0).otherwise(gap))
        s = s.withColumn("lo", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")))
        full = F.col("lam") - F.col("gap") / (F.greatest(F.col("slope").cast("double"), F.lit(1.0)) / _UNIT)
        # Before both ends of the bracket are known a long step is cut; after that it is halved into it.
        open_end = (F.abs("lo") >= 1e6) | (F.abs("hi") >= 1e6)
        width = F.greatest(F.lit(0.5), F.abs("lam"))
        cut = F.least(F.greatest(full, F.col("lam") - width), F.col("lam") + width)
        step = F.when((full > F.col("lo")) & (full < F.col("hi")) & ~open_end, full).when(open_end, cut).otherwise((F.col("lo") + F.col("hi")) / 2)
        s = s.withColumn("done", F.col("done") | (F.abs("gap") <= near * F.col("target")) | (F.col("hi") - F.col("lo") < 1e-12))
        s = s.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(step))
        state = keep(s.select("sr", "target", "mean", "words", "lam", "lo", "hi", "done").coalesce(1), "multipliers")
        if not state.where("not done").take(1):
            break
    return state.select("sr", "lam", "mean")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs(doc_id, text, source)``."""
    sized = keep(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized")
    salts = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    cells = keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")).coalesce(8), "cells")
    sources = keep(targets(cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("words")), weights, most).coalesce(1), "sources")
    named = keep(cells.join(sources.select("source", "sr"), cells["source"].eqNullSafe(sources["source"])).select("sr", cells["source"], "size", "n").coalesce(8), "named")
    lam = solve(named, sources, most)

    rated = named.join(lam, "sr", "left").withColumn("rate", F.when(F.col("size") > 0, F.coalesce(_rate("lam", "size", "mean", most), F.lit(0))).otherwise(0).cast("long"))
    along = Window.partitionBy("sr").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("from", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(along), F.lit(0)) + _UNIT // 2)
    rated = rated.join(sources.select("sr", F.col("words").alias("source_size"), "target"), "sr")
    rated = keep(rated.select("source", "size", "rate", "from", "source_size", "target", F.ceil(F.col("n") / _SALTED).alias("parts")).coalesce(8), "rated")

    placed = salts.join(rated, salts["source"].eqNullSafe(rated["source"]) & (salts["size"] == rated["size"])).select("doc_id", salts["source"], salts["size"], "rate", "from", "source_size", "target", (F.col("salt") % F.col("parts")).alias("part"))
    placed = keep(placed, "placed")
    sums = placed.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = keep(sums.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("part").alias("p2"), "ahead").where("ahead > 0"), "ahead")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id"))
    ranked = placed.withColumn("k", rank)
    out = ranked.join(sums, ranked["source"].eqNullSafe(sums["s2"]) & (ranked["size"] == sums["z2"]) & (ranked["part"] == sums["p2"]), "left")
    upto = F.col("from") + (F.col("k") + F.coalesce("ahead", F.lit(0))) * F.col("rate")
    copies = (F.shiftright(upto, 20) - F.shiftright(upto - F.col("rate"), 20)).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))
