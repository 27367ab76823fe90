"""Mixing sources to target weights by entropy balancing.

Of all document rates that give each source its target number of words and stay between 0 and 3, the mix takes those
closest, in relative entropy, to taking every document once. They are exponentially tilted: the rate of a document is
exp(multiplier * size), at most 3, with one multiplier per source. The multipliers solve the convex dual; its gradient and
curvature are sums over documents, so every Newton step is a distributed aggregate. Documents of equal source and size
share a rate, so the sums run over one row per source and size. A bracket kept beside each multiplier guards steps that leave it.

Rates become copies from the largest size to the smallest, each size making up for what rounding left before it. Inside
a size the documents with one copy more are chosen by a hash of their id, in groups of some dozens of documents, so no group is
ever gathered, and a second run chooses the same.

Results in odd cases: NULL or blank text has size 0, is taken once and adds nothing. A NULL source is a source of its own
and comes last. Where all sizes of a source are 0 its target is 0. Repeated rows are documents of their own. A source
with few documents comes as near its target as whole copies allow. Further input columns stay in `mixed` and are ignored
by `mixing_plan`. An empty table gives an empty plan.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.shared import few, stored, unused

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: No document, and so no source, counts more often than this.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps between two written tables, and the most such rounds.
STEPS, ROUNDS = 4, 40
TOLERANCE = 1e-9
#: Documents of one source and size that are ranked together.
GROUP = 64
_BIG = 1e6


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: place, source_size and target. Input: source, size, n.

    Sources in order of code points, NULL last, get shares of all words by weight; none gets more than `MOST` times its size,
    and what is over is shared again by weight among the others. One row per source is all that is ordered here.
    """
    listed = F.array(*(F.lit(float(x)) for x in weights))
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    placed = placed.withColumn("weight", F.get(listed, F.pmod(F.col("place") - 1, F.lit(len(weights))))).withColumn("most", F.col("source_size") * MOST)
    # A source is full at the level most / weight. The level that spends everything is the highest at which the sources
    # below are full and the rest, by weight, takes what they leave.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "place")
    below, above = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(below), F.lit(0))
    placed = placed.withColumn("level", left / F.sum("weight").over(above))
    level = F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.coalesce(level * F.col("weight"), F.col("most").cast("double")))
    return placed.select("source", "place", "source_size", target.alias("target"))


def _tilted(cells: DataFrame, most: float = MOST) -> DataFrame:
    """Cells with their `rate`. Input: place, size, n, source_size, target."""
    # Sizes are scaled by the source's mean word's document, so multipliers are of the order of one.
    scale = cells.groupBy("place").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    cells = stored(cells.join(F.broadcast(scale) if scale.count() <= 100_000 else scale, "place").withColumn("x", F.col("size") / F.col("scale")), "cells")
    sources = cells.groupBy("place").agg(F.first("target").alias("target"), F.first("source_size").alias("whole"))
    state = sources.select("place", "target", "whole", F.lit(0.0).alias("tilt"), F.lit(-_BIG).alias("low"), F.lit(_BIG).alias("high"), F.lit(1.0).alias("error"))
    tilt = lambda: F.least(F.col("tilt") * F.col("x"), F.lit(math.log(most)))
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            rated = cells.select("place", "n", "size", "x").join(state, "place").withColumn("rate", F.exp(tilt()))
            inner = F.col("tilt") * F.col("x") < math.log(most)
            sums = rated.groupBy("place").agg(
                *(F.first(c).alias(c) for c in ("target", "whole", "tilt", "low", "high")),
                (F.sum(F.col("n") * F.col("size") * F.col("rate")) - F.first("target")).alias("over"),
                F.sum(F.when(inner, F.col("n") * F.col("size") * F.col("x") * F.col("rate")).otherwise(0.0)).alias("slope"))
            high = F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))
            low = F.when(F.col("over") > 0, F.col("low")).otherwise(F.col("tilt"))
            bounded = sums.withColumns({"high": high, "low": low}).withColumn("step", F.col("tilt") - F.try_divide("over", "slope"))
            middle = (F.col("low") + F.col("high")) / 2
            good = F.col("step").isNotNull() & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
            error = F.abs("over") / F.col("whole")
            moved = F.when(error <= TOLERANCE, F.col("tilt")).when(good, F.col("step")).otherwise(middle)
            state = bounded.select("place", "target", "whole", moved.alias("tilt"), "low", "high", error.alias("error"))
        state = stored(state, "state")
        if (state.agg(F.max("error")).first()[0] or 0) <= TOLERANCE:
            break
    else:
        raise ArithmeticError(f"a source has not come within {TOLERANCE} of its target in {ROUNDS * STEPS} steps")
    rate = F.when(F.col("target") >= most * F.col("whole"), F.lit(float(most))).otherwise(F.round(F.exp(tilt()), 9))
    return cells.join(state.select("place", "whole", F.round("tilt", 12).alias("tilt")), "place").withColumn("rate", rate)


def _copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies in all of each size of one source, from the largest size down; what rounding leaves goes to the next size.

    One row per distinct size, so the group does not grow with the number of documents.
    """
    cells = cells.sort_values("size", ascending=False)
    over, out = 0.0, []
    for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
        wanted = n * rate * size + over
        copies = min(MOST * n, max(0, math.floor(wanted / size + 0.5)))
        over = wanted - copies * size
        out.append(copies)
    return cells[["place", "size"]].assign(copies=out)


def _counts(sized: DataFrame, weights: tuple[int, ...], key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with source_size, target and `taken_times`. Input: `source`, `size` and what tells rows apart; all its columns stay."""
    cells = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    aims = stored(targets(cells, weights), "targets")
    placed = cells.join(aims, cells["source"].eqNullSafe(aims["source"])).select(cells["source"], "place", "size", "n", "source_size", "target")
    placed = stored(placed, "placed")
    rated = _tilted(placed.where("size > 0 and target > 0"))
    copies = rated.select("place", "size", "n", "rate").groupBy("place").applyInPandas(_copies, "place int, size long, copies long")
    chosen = stored(placed.join(copies, ["place", "size"], "left").withColumn("copies", F.coalesce("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(0))), "copies")
    chosen = chosen.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "place", "n", "source_size", "target", "copies")
    columns = sized.columns
    joined = sized.join(few(chosen, 200_000), sized["source"].eqNullSafe(F.col("_source")) & (sized["size"] == F.col("_size")))
    joined = joined.withColumns({"each": F.expr("copies div n"), "extra": F.expr("copies % n"), "mark": F.xxhash64(*key, F.lit("mix"))})
    # Only where some documents of a size get one copy more than others are they ranked, a small group at a time.
    even = joined.where("extra = 0").withColumn("taken_times", F.col("each"))
    parts = F.ceil(F.col("n") / GROUP)
    split = joined.where("extra > 0").withColumn("part", F.pmod(F.xxhash64(*key, F.lit("part")), parts))
    group = Window.partitionBy("place", "size", "part")
    chance = F.pmod(F.xxhash64("place", "size", "part"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.floor(F.count("*").over(group) * F.col("extra") / F.col("n") + F.when(parts > 1, chance).otherwise(0.0) + 1e-9)
    split = split.withColumn("taken_times", F.col("each") + (F.row_number().over(group.orderBy("mark", *key)) <= share).cast("long"))
    wanted = [*columns, "source_size", "target", "taken_times"]
    return even.select(*wanted).unionByName(split.select(*wanted))


def mixing_plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words the mix takes), copies."""
    sized = stored(documents.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sized")
    return _counts(sized, weights).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_times")).alias("taken"), F.col("taken_times").alias("copies"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: every row as often as the plan takes it, with `copy` counting from 1 (`copy_` where the input has a `copy`).

    Rows are written with a number of their own, so that rows without an id or of one id each get their own copies;
    a second run over the same files chooses the same.
    """
    columns = documents.columns
    row, words, times, copy = (unused(columns, x) for x in ("_row", "_words", "_copies", "copy"))
    numbered = stored(documents.withColumns({row: F.monotonically_increasing_id(), words: size_of(F.col("text"))}), "numbered")
    sized = numbered.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id"), "source", F.col(words).alias("size"))
    plan = _counts(sized, weights, ("_id", "_row")).where("taken_times > 0").select(F.col("_row").alias(row), F.col("taken_times").cast("int").alias(times))
    joined = numbered.join(few(stored(plan, "plan")), row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns, copy)
