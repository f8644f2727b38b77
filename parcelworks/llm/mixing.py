"""Mixing sources to target weights by entropy balancing.

Method: every document gets a rate; among all rates that give each source its target number of words
(and that stay within the cap on repeats) those nearest to 1 in relative entropy are wanted. The convex
dual has one multiplier a source, and its solution is an exponential tilt, ``min(cap, exp(lambda * size))``.
Safeguarded Newton iterations find the multipliers; each is one distributed aggregation over (source, size)
counts, which are exact sufficient statistics. The rates are then rounded into copies by systematic
rounding along (source, size). DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.llm.shared import drop_stash, stash, table, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size). Sources in code-point order, null last, take the
    weights in turn and share ``share`` times all words; a target stops at ``cap`` times its source's size
    and the excess goes to the others by weight until none is above, in closed form: with sources by
    rising cap / weight, the first k are capped where the level that remains for the others exceeds it.
    Its windows run over one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("__n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("__w", F.get(turn, ((F.col("__n") - 1) % len(weights)).cast("int"))).withColumn("__cap", cap * F.col("source_size"))
    ranked = ranked.withColumn("__full", F.col("__cap") / F.col("__w"))
    by_cap = Window.orderBy("__full", "__n")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumns(
        {
            "__total": share * F.sum("source_size").over(everything),
            "__used": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
            "__weight": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
        }
    ).withColumn("__level", (F.col("__total") - F.col("__used")) / F.col("__weight"))
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__full", "__n", "__level"))
    free = F.min(fits).over(everything)["__level"]
    target = F.least(F.col("__cap"), F.coalesce(free * F.col("__w"), F.col("__cap")))
    return levels.select("source", "source_size", target.alias("target"))


def _rate(cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), F.col("__lambda") * F.col("__x"))))


def balance(counts: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-10, max_steps: int = 60) -> DataFrame:
    """(source, __lambda, source_size, target): the multipliers. ``counts`` has (source, size, n). Sizes are
    scaled by their source's mean. A Newton step that leaves the bracket is replaced by its middle; the sums
    are decimals, so that their order does not matter and reruns agree. Sources not settled after ``max_steps`` raise an error."""
    means = counts.groupBy("source").agg(F.sum("n").alias("__docs"))
    mean = F.col("source_size") / F.col("__docs")
    most, full = F.log(F.lit(cap)) * mean, F.col("target") >= cap * F.col("source_size")  # at most, every word is taken cap times
    start = targets.join(means, F.equal_null(targets["source"], means["source"])).select(
        targets["source"],
        "source_size",
        "target",
        mean.alias("__mean"),
        F.when(full, most).otherwise(0.0).alias("__lambda"),
        (-50 * mean).alias("__lo"),
        most.alias("__hi"),
        full.alias("__done"),
    )
    state = stash(start, "mix-dual")
    for _ in range(max_steps):
        at = state.select(F.col("source").alias("__s"), "__lambda", "__mean")
        rows = counts.join(at, F.equal_null(counts["source"], at["__s"])).where("size > 0").withColumn("__x", F.try_divide("size", "__mean"))
        words = F.col("n") * F.col("__x") * _rate(cap)
        bend = F.when(_rate(cap) < cap, words * F.col("__x")).otherwise(0.0)
        sums = rows.groupBy("source").agg(F.sum(words.cast("decimal(38,12)")).alias("__words"), F.sum(bend.cast("decimal(38,12)")).alias("__bend"))
        sums = sums.select(F.col("source").alias("__s"), F.col("__words").cast("double"), F.col("__bend").cast("double"))
        joined = state.join(sums, F.equal_null(state["source"], sums["__s"]), "left").drop("__s")
        goal = F.coalesce(F.try_divide("target", "__mean"), F.lit(0.0))
        gap = F.coalesce("__words", F.lit(0.0)) - goal
        lo = F.when(gap < 0, F.col("__lambda")).otherwise(F.col("__lo"))
        hi = F.when(gap > 0, F.col("__lambda")).otherwise(F.col("__hi"))
        newton = F.col("__lambda") - gap / F.when(F.col("__bend") > 0, F.col("__bend"))
        inside = (newton > lo) & (newton < hi)
        done = F.col("__done") | (F.abs(gap) <= tolerance * goal) | (hi - lo < 1e-13)
        moved = F.when(done, F.col("__lambda")).when(inside, newton).otherwise((lo + hi) / 2)
        step = joined.select("source", "source_size", "target", "__mean", moved.alias("__lambda"), lo.alias("__lo"), hi.alias("__hi"), done.alias("__done"))
        before, state = state, stash(step, "mix-dual")
        drop_stash(before)
        if state.where("NOT __done").isEmpty():
            break
    else:
        raise RuntimeError(f"multipliers not settled after {max_steps} steps")
    return state.withColumn("__lambda", F.round("__lambda", 11))


def mix_to_weights(
    sizes: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    unit_rows: int = 10_000,
    phases: int = 32,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) from (doc_id, source, size), a row in, a row out.

    A document's copies are the whole numbers that the running sum of rates passes on its row, in the order
    of source, size and a hash of the id; so no document exceeds ``cap`` (rounded up) copies and a source's
    words miss its target by less than about one document's size; of ``phases`` starts of that running sum
    each source takes the one that comes nearest. To keep one large group of equal sizes out of one task, (source, size)
    groups are split into units of about ``unit_rows`` rows by a hash; the running sum over units comes from
    their counts, and rows are ranked inside their unit only.

    Defined cases: null sizes count 0; a document of size 0 has no words to take; null sources form one
    source, the last. Ids may repeat or be null: rows are ranked by hash and id, and rows that are alike in
    all of these take their copies in either order, which gives the same result. An empty table gives none.
    """
    sizes = stash(sizes.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")), "mix-sizes")
    counts = stash(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    dual = balance(counts, source_targets(sizes, weights, share, cap), cap)
    dual = dual.select(F.col("source").alias("__s"), "__lambda", "__mean", "source_size", "target")
    rated = counts.join(dual, F.equal_null(counts["source"], dual["__s"])).drop("__s").withColumn("__x", F.coalesce(F.col("size") / F.when(F.col("__mean") > 0, F.col("__mean")), F.lit(0.0)))
    rated = rated.withColumn("__rate", F.round(_rate(cap), 12)).select(
        F.col("source").alias("__s"), F.col("size").alias("__z"), F.ceil(F.col("n") / unit_rows).alias("__parts"), "__rate", "source_size", "target"
    )
    units = sizes.join(rated, F.equal_null(sizes["source"], rated["__s"]) & (sizes["size"] == rated["__z"])).drop("__s", "__z")
    units = units.withColumn("__hash", F.xxhash64(F.lit("mix"), "doc_id")).withColumn("__part", F.pmod("__hash", "__parts"))
    counted = units.groupBy("source", "size", "__part").agg(F.count(F.lit(1)).alias("__n"), F.first("__rate").alias("__r"))
    before = Window.partitionBy("source").orderBy("size", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("__base", F.coalesce(F.sum(F.col("__n") * F.col("__r")).over(before), F.lit(0.0)))
    offsets = offsets.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("__part").alias("__p"), "__base")
    placed = units.join(offsets, F.equal_null(units["source"], offsets["__s"]) & (units["size"] == offsets["__z"]) & (units["__part"] == offsets["__p"]))
    rank = F.row_number().over(Window.partitionBy("source", "size", "__part").orderBy("__hash", "doc_id"))
    placed = stash(placed.withColumn("__k", rank).select("doc_id", "source", "size", "source_size", "target", "__base", "__rate", "__k"), "mix-placed")

    def copies(phase: Column) -> Column:
        passed = [F.floor(F.round(F.col("__base") + k * F.col("__rate") + phase, 6)) for k in (F.col("__k"), F.col("__k") - 1)]
        return F.when(F.col("size") > 0, F.least(F.lit(math.ceil(cap)), passed[0] - passed[1])).otherwise(0).cast("int")

    starts = [(i + 0.5) / phases for i in range(phases)]
    words = placed.groupBy("source").agg(F.first("target").alias("__t"), F.array(*[F.sum(copies(F.lit(u)) * F.col("size")) for u in starts]).alias("__words"))
    misses = F.transform("__words", lambda x, i: F.struct(F.abs(x - F.col("__t")).alias("miss"), i.alias("i")))
    phase = words.select(F.col("source").alias("__s"), ((F.array_min(misses)["i"] + 0.5) / phases).alias("__phase"))
    mixed = placed.join(phase, F.equal_null(placed["source"], phase["__s"])).withColumn("copies", copies(F.col("__phase")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mixing(spark, sf_dir):
    """The mix of all documents: what each of them gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_to_weights(docs).select("doc_id", "size", "source_size", "target", "taken")
