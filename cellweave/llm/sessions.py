"""Sessions over batches that arrive late: every version of a session, and which later version retracts it.

After each batch, a user's events so far form sessions; neighbours in time at
most `gap` apart share one.  A session that holds an event of the batch is a new
version and retracts the earlier ones that it contains.

A point in time is a *start* while it is present and no earlier point within the
gap is.  So a start is born with the point's first batch and dies with the
least batch over the gap before it, which a range window finds; ends are the
same in reversed time.  The session of an event, as of its batch, begins at the
latest living start: an as-of match.  Timelines are cut into slots; in a slot,
living starts of one batch are more than a gap apart, so the match joins a
bounded number of them to each batch.  Sessions that begin in an earlier slot
are followed from killer to killer by doubled steps.  Numbers of events add up
along the versions that one another retract, by doubled steps too, so long
chains take few rounds.

Events of one user and second that share a batch are added up first.  Every
window, group and join is keyed by user and slot, user and time, or version, so
a user with a third of all rows is dealt over time (the versions of one start,
at most one a batch, share a window).  Nothing is broadcast or collected.

Defined results: rows without a user, time or batch take no part; repeated rows
are events of their own; a null value adds nothing; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.llm._base import checkpointed, saved

#: A slot's length in gaps.
SLOT_GAPS = 16


def _slot(length: int) -> Column:
    return (F.col("t") - F.pmod("t", F.lit(length))) / length


def dated(points: DataFrame, gap: int) -> DataFrame:
    """(user, slot, t, born, dies, killer) of each point; `dies` is null where nothing precedes it within the gap.

    The killer is the earliest point that arrives with that batch.
    """
    length = SLOT_GAPS * gap
    own = _slot(length).cast("long")
    late = F.pmod("t", F.lit(length)) >= length - gap
    copies = points.withColumn("own", own).withColumn("slot", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    before = Window.partitionBy("user", "slot").orderBy("t").rangeBetween(-gap, -1)
    found = copies.withColumn("by", F.min(F.struct("born", "t")).over(before)).where(F.col("slot") == F.col("own"))
    return found.select("user", "slot", "t", "born", F.col("by.born").alias("dies"), F.col("by.t").alias("killer"))


def as_of(events: DataFrame, points: DataFrame) -> DataFrame:
    """The events with `found`, the latest start of their own slot that lives at their batch (null: none)."""
    batches = events.select("user", "slot", "batch").distinct()
    lives = (F.col("born") <= F.col("batch")) & (F.col("dies").isNull() | (F.col("batch") < F.col("dies")))
    living = points.where(F.col("dies").isNull() | (F.col("born") < F.col("dies"))).join(batches, ["user", "slot"]).where(lives)
    both = events.withColumn("start", F.lit(None).cast("long")).unionByName(living.select("user", "slot", "batch", "t", F.col("t").alias("start")), allowMissingColumns=True)
    so_far = Window.partitionBy("user", "slot", "batch").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.max("start").over(so_far)).where("n IS NOT NULL").drop("start")


def climbed(events: DataFrame, points: DataFrame) -> DataFrame:
    """`found` of events whose session begins in an earlier slot: the first of their killers in turn that lives at their batch."""
    step = saved(points.where(F.col("dies").isNotNull()).select("user", F.col("t").alias("at"), F.col("killer").alias("to"), F.col("dies").alias("most")))
    levels = []
    while not step.isEmpty():
        levels.append(step)
        further = step.select("user", F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("most").alias("more"))
        step = saved(step.join(further, ["user", "to"]).select("user", "at", F.col("beyond").alias("to"), F.greatest("most", "more").alias("most")))
    held = events.withColumn("at", F.col("t"))
    for level in reversed(levels):
        held = held.join(level, ["user", "at"], "left").withColumn("at", F.when(F.col("most") <= F.col("batch"), F.col("to")).otherwise(F.col("at"))).drop("to", "most")
    return held.withColumn("found", F.col("at")).drop("at")


def bounds(events: DataFrame, gap: int) -> tuple[DataFrame, DataFrame]:
    """(events with `found`, points): the start of each event's session at its batch; points with their lives."""
    points = checkpointed(dated(events.groupBy("user", "t").agg(F.min("batch").alias("born")), gap))
    slotted = events.withColumn("slot", _slot(SLOT_GAPS * gap).cast("long"))
    matched = checkpointed(as_of(slotted, points))
    rest = matched.where(F.col("found").isNull())
    if rest.isEmpty():
        return matched.drop("slot"), points
    return checkpointed(matched.where(F.col("found").isNotNull()).unionByName(climbed(rest, points)).drop("slot")), points


def merge_sessions(events: DataFrame, user: Column | str = "user", time: Column | str = "time", batch: Column | str = "batch", gap: int = 240, value: Column | str | None = None) -> DataFrame:
    """(user, batch, start, end, n_events, n_new, n_retracted, total, retracted_batch, retracted_start): every version.

    `time` and `batch` are integers; `total` adds `value` over the events;
    `retracted_*` name the version that retracts this one (null: it is final).
    """
    if gap < 1:
        raise ValueError("gap must be at least 1")
    column = lambda c: F.col(c) if isinstance(c, str) else c
    named = events.select(column(user).alias("user"), column(time).cast("long").alias("t"), column(batch).cast("long").alias("batch"), (F.lit(0) if value is None else column(value)).cast("long").alias("v")).dropna(subset=["user", "t", "batch"])
    equal = checkpointed(named.groupBy("user", "t", "batch").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")))
    begun, points = bounds(equal, gap)
    turned = begun.withColumn("t", -F.col("t")).withColumnRenamed("found", "first")
    both, _ = bounds(turned, gap)
    both = both.select("user", (-F.col("t")).alias("t"), "batch", "n", "v", "first", (-F.col("found")).alias("last"))
    versions = both.groupBy("user", "batch", "first").agg(F.max("last").alias("last"), F.sum("n").alias("n_new"), F.sum("v").alias("v"))
    # A start that dies is absorbed by the session of its killer, in the batch that brings the killer.
    killed = points.where(F.col("dies").isNotNull() & (F.col("born") < F.col("dies"))).select("user", F.col("t").alias("dead"), F.col("killer").alias("t"), F.col("dies").alias("batch"))
    absorbed = killed.join(both.select("user", "t", "batch", "first"), ["user", "t", "batch"]).select("user", F.col("dead").alias("first"), F.col("batch").alias("dies"), F.col("first").alias("into"))
    later = Window.partitionBy("user", "first").orderBy("batch")
    following = versions.withColumn("next", F.lead("batch").over(later)).join(absorbed, ["user", "first"], "left")
    linked = checkpointed(following.select(
        "user", "batch", "first", "last", "n_new", "v",
        F.coalesce("next", "dies").alias("up_batch"),
        F.when(F.col("next").isNotNull(), F.col("first")).otherwise(F.col("into")).alias("up_first"),
    ))
    totals = _totals(linked)
    counts = linked.where("up_batch IS NOT NULL").groupBy("user", F.col("up_batch").alias("batch"), F.col("up_first").alias("first")).agg(F.count(F.lit(1)).alias("children"))
    key = ["user", "batch", "first"]
    return linked.join(totals, key).join(counts, key, "left").select(
        "user", "batch", F.col("first").alias("start"), F.col("last").alias("end"), "n_events", "n_new",
        F.coalesce("children", F.lit(0)).cast("long").alias("n_retracted"), "total",
        F.col("up_batch").alias("retracted_batch"), F.col("up_first").alias("retracted_start"),
    )


def _totals(versions: DataFrame) -> DataFrame:
    """(user, batch, first, n_events, total): a version's own sums and those of all that it retracts, at any depth.

    After k rounds a row holds the sums of 2**k generations and points 2**k versions up.
    """
    key = ["user", "batch", "first"]
    held = saved(versions.select(*key, F.col("n_new").alias("n"), "v", "up_batch", "up_first"))
    while not (active := held.where("up_batch IS NOT NULL")).isEmpty():
        adds = active.select("user", F.col("up_batch").alias("batch"), F.col("up_first").alias("first"), "n", "v")
        # A row that points nowhere looks up itself, so that such rows share no key.
        aimed = held.withColumns({"at_batch": F.coalesce("up_batch", "batch"), "at_first": F.coalesce("up_first", "first")}).drop("up_batch", "up_first")
        above = held.select("user", F.col("batch").alias("at_batch"), F.col("first").alias("at_first"), "up_batch", "up_first")
        moved = aimed.join(above, ["user", "at_batch", "at_first"]).select(*key, "n", "v", "up_batch", "up_first")
        summed = moved.unionByName(adds, allowMissingColumns=True).groupBy(*key)
        held = saved(summed.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("up_batch").alias("up_batch"), F.max("up_first").alias("up_first")))
    return held.select(*key, F.col("n").alias("n_events"), F.col("v").alias("total"))
