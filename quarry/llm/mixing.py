"""Mixing sources to target weights by entropy balancing.  DataFrame operations only.

Targets.  The sources, in code-point order with null last, take the weights in turn and share a budget of words in
proportion to them, where no source may pass ``limit`` times its own size and the excess is shared again: the target is
``min(limit * size, weight * level)``, and the level follows from running sums over the sources in the order in which
they saturate.

Rates.  Every document starts at rate one and may rise to ``limit``.  Among all rates between 0 and ``limit`` that meet
a source's token constraint, those closest in (Fermi-Dirac) entropy to the starting rate are exponentially tilted:
``limit / (1 + (limit - 1) * exp(-multiplier * size / mean size))``.  The multipliers solve the convex dual.  They are
found by Newton iterations, each one a distributed aggregation over the histogram of document sizes by source.  From
zero the iterates approach the root from one side only, so no step needs damping for ``limit`` 2; a step is capped to
keep it so for others.  Saturated sources need no multiplier: their rate is ``limit``.

Copies.  A document takes the whole part of its rate; the fractions are rounded by order sampling: a document's
priority is a hash of its id and text size, divided by its fraction, and documents take one more copy in order of
priority until the source's target is met.  The cut is found digit by digit, by histograms of priorities with
256 bins a source, and rows are ordered only within the one fine bin that it falls in, so that no source is brought into one task.  Last, one document of each
source gains or loses a copy where that brings the source closer to its target.

Defined cases: a null text has size 0 and takes nothing; null sources form one source; a source without words has target
0; rows that tie in priority (repeated rows) are taken in either order, which gives the same rows; an empty table gives
an empty table; other columns may have any name but those that start with ``__mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
#: Priorities are cut into 2**24 fine bins, found by three digits of 8 bits.
BIN_BITS, DIGITS = 8, 3
NEWTON_ROUNDS = 60
#: Largest relative distance from a target at which the iterations end.
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sizes (source, size): one row per source with ``source_size`` and ``target``.  Windows run over sources only."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    # in the order in which sources saturate, the level at which the next one does
    saturates = F.col("cap") / F.col("weight")
    before = Window.orderBy(saturates, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        total.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * limit)
        .withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("heavier", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    )
    # counting one more source as saturated raises what is left for each weight exactly while it is saturated there
    level = F.max(F.col("left") / F.col("heavier")).over(everything)
    return ranked.select("source", "source_size", "n", F.least("cap", F.col("weight") * level).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, limit: float) -> Column:
    return limit / (1 + (limit - 1) * F.exp(-multiplier * size / mean))


def multipliers(sizes: DataFrame, targets: DataFrame, limit: float = LIMIT) -> scratch.Table:
    """targets with the columns mean and multiplier (null: at the limit), by Newton iterations on the dual."""
    spark = sizes.sparkSession
    histogram = scratch.materialize(
        sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "size-histogram"
    )
    free = F.col("target") < limit * F.col("source_size") * (1 - 1e-12)
    now = scratch.materialize(
        targets.select("*", (F.col("source_size") / F.col("n")).alias("mean"), F.when(free, F.lit(0.0)).alias("multiplier"), F.lit(None).cast("double").alias("gap")),
        "multipliers",
    )
    for _ in range(NEWTON_ROUNDS):
        state = now.df.select("source", "mean", "multiplier").where(F.col("multiplier").isNotNull() & (F.col("mean") > 0))
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), limit)
        words = F.col("docs") * F.col("size")
        sums = (
            histogram.df.withColumnRenamed("source", "of")
            .join(state, F.col("of").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(F.sum(words * rate).alias("taken"), F.sum(words * rate * (1 - rate / limit) * F.col("size") / F.col("mean")).alias("slope"))
            .withColumnRenamed("source", "of")
        )
        step = (F.col("target") - F.col("taken")) / F.col("slope")
        moved = now.df.drop("gap").join(sums, F.col("of").eqNullSafe(F.col("source")), "left")
        new = scratch.materialize(
            moved.select(
                "source", "source_size", "n", "target", "mean",
                F.when(F.col("slope") > 0, F.col("multiplier") + F.greatest(F.least(step, F.lit(8.0)), F.lit(-8.0))).otherwise(F.col("multiplier")).alias("multiplier"),
                (F.abs(F.col("target") - F.col("taken")) / F.col("source_size")).alias("gap"),
            ),
            "multipliers",
        )
        now.drop()
        now = new
        gap = now.df.agg(F.max("gap")).first()[0]
        if gap is None or gap < TOLERANCE:
            break
    histogram.drop()
    return now


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies and taken, and the columns of ``carry``."""
    docs = df.select(F.col(id_col).alias("__mix_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.length(text_col).alias("__mix_length"), *carry)
    sizes = scratch.materialize(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "mix-sizes")
    targets = scratch.materialize(source_targets(sizes.df, weights, share, limit), "mix-targets")
    # sums of doubles end in digits that depend on the order in which tasks finish; these are rounded away
    solved = multipliers(sizes.df, targets.df, limit).df.withColumn("multiplier", F.round("multiplier", 9)).withColumnRenamed("source", "of")
    rate = F.coalesce(_rate(F.col("multiplier"), F.col("size"), F.col("mean"), limit), F.lit(limit))
    # 52 bits of a digest: the same number on any engine, cluster and partitioning
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("__mix_id").cast("string"), F.lit("null")), "size", "__mix_length").cast("binary"))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    rated = sizes.df.join(solved, F.col("of").eqNullSafe(F.col("source"))).drop("of").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
    fraction = F.col("rate") - F.floor("rate")
    fine = 1 << DIGITS * BIN_BITS
    # priorities u / fraction run from 0 up; p / (1 + p) keeps their order and fits the bins
    priority = F.col("__mix_u") / fraction
    marked = scratch.materialize(
        rated.withColumn("whole", F.floor("rate"))
        .withColumn("__mix_u", uniform)
        .withColumn("priority", F.when(fraction > 0, priority / (1 + priority)))
        .withColumn("bin", F.least(F.floor(F.col("priority") * fine), F.lit(fine - 1))),
        "mix-rated",
    )
    rows = marked.df
    candidates = rows.where(F.col("bin").isNotNull())
    whole = rows.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("have"))
    wanted = whole.select(F.col("source").alias("of"), (F.col("target") - F.col("have")).alias("wanted"))

    def crossing(inside: DataFrame, need: DataFrame, shift: int) -> DataFrame:
        """The bin in which the running size passes what is wanted, and what is still wanted there."""
        sums = inside.groupBy("source", F.shiftright("bin", shift).alias("part")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("words").over(upto)).join(need, F.col("of").eqNullSafe(F.col("source"))).drop("of")
        least = F.min(F.struct("part", (F.col("wanted") - F.col("upto") + F.col("words")).alias("rest"))).alias("c")
        passed = run.where(F.col("upto") > F.col("wanted")).groupBy("source").agg(least)
        return passed.select(F.col("source").alias("of"), F.col("c.part").alias("cut"), F.col("c.rest").alias("wanted"))

    inside, need = candidates, wanted
    for digit in reversed(range(DIGITS)):
        found = scratch.materialize(crossing(inside, need, digit * BIN_BITS), "mix-cut")
        cut, need = found.df, found.df.select("of", "wanted")
        here = F.shiftright("bin", digit * BIN_BITS) == F.col("cut")
        inside = candidates.join(found.df.drop("wanted"), F.col("of").eqNullSafe(F.col("source")) & here).drop("of", "cut")
    against = rows.join(cut, F.col("of").eqNullSafe(F.col("source")), "left").drop("of")
    fine_order = Window.partitionBy("source").orderBy("priority", "__mix_id", "__mix_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = against.where(F.col("bin") == F.col("cut"))
    # at the edge a document is taken while the sum with half of it stays within what is wanted
    at_edge = edge.withColumn("extra", (F.sum("size").over(fine_order) - F.col("size") / 2 <= F.col("wanted")).cast("long"))
    rest = against.where((F.col("bin") == F.col("cut")).isNull() | (F.col("bin") != F.col("cut")))
    apart = rest.withColumn("extra", F.coalesce((F.col("bin") < F.coalesce("cut", F.lit(fine))).cast("long"), F.lit(0)))
    copies = F.col("whole") + F.col("extra")
    rounded = scratch.materialize(
        at_edge.unionByName(apart).select(
            "__mix_id", "__mix_row", "__mix_u", "source", "size", "source_size", "target", "rate", "extra", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry
        ),
        "mix-rounded",
    )
    done = _settle(rounded.df, limit)
    return done.select(F.col("__mix_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", "taken", *carry)


def _settle(rounded: DataFrame, limit: float) -> DataFrame:
    """Changes, by one copy, the one document of each source that brings the source closest to its target."""
    gaps = rounded.groupBy("source").agg((F.max("target") - F.sum("taken")).alias("gap")).withColumnRenamed("source", "of")
    more = (F.col("size") > 0) & (F.col("gap") > 0) & (F.col("copies") + 1 <= limit)
    less = (F.col("size") > 0) & (F.col("gap") < 0) & (F.col("copies") >= 1)
    after = F.when(more, F.abs(F.col("gap") - F.col("size"))).when(less, F.abs(F.col("gap") + F.col("size")))
    best = (
        rounded.join(gaps, F.col("of").eqNullSafe(F.col("source")))
        .where(after < F.abs("gap"))
        .groupBy("source")
        .agg(F.min(F.struct(after.alias("after"), F.col("__mix_u").alias("u"), F.col("__mix_row").alias("row"), F.signum("gap").cast("long").alias("change"))).alias("best"))
        .select(F.col("best.row").alias("__mix_row"), F.col("best.change").alias("change"))
    )
    change = F.coalesce("change", F.lit(0))
    return (
        rounded.join(best, "__mix_row", "left")
        .withColumn("copies", F.col("copies") + change)
        .withColumn("taken", F.col("taken") + change * F.col("size"))
    )
