"""Provenance audits: who was fitted on what, and whether that leaks into what is predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.validate import violations


def leaks(samples: DataFrame, footprints: DataFrame) -> DataFrame:
    """(artifact, kind, n_leaks): samples whose own artifact was fitted, tuned or calibrated on them or their group.

    `samples` has (sample_id, group_id, artifact), `footprints` (artifact, stage,
    kind, id) with kind sample or group.
    """
    held = footprints.select("artifact", "kind", "id")
    asked = samples.select("artifact", F.lit("sample").alias("kind"), F.col("sample_id").alias("id")).unionByName(samples.select("artifact", F.lit("group").alias("kind"), F.col("group_id").alias("id")))
    hits = asked.join(held, ["artifact", "kind", "id"], "left_semi")
    return hits.groupBy("artifact", "kind").agg(F.count(F.lit(1)).alias("n_leaks"))


def footprint_consistency(samples: DataFrame, footprints: DataFrame) -> DataFrame:
    """(artifact, n_unknown_samples, n_groups_not_declared): sample ids that do not exist, and groups of footprint
    samples that the artifact's group footprint leaves out."""
    mine = footprints.where("kind = 'sample'").select("artifact", F.col("id").alias("sample_id")).distinct()
    known = mine.join(samples.select("sample_id", "group_id"), "sample_id", "left")
    declared = footprints.where("kind = 'group'").select("artifact", F.col("id").alias("group_id")).distinct().withColumn("__d", F.lit(1))
    joined = known.join(declared, ["artifact", "group_id"], "left")
    return joined.groupBy("artifact").agg(F.count_if(F.col("group_id").isNull()).alias("n_unknown_samples"), F.count_distinct(F.when(F.col("group_id").isNotNull() & F.col("__d").isNull(), F.col("group_id"))).alias("n_groups_not_declared"))


def _classes(members: DataFrame) -> DataFrame:
    """(sample_id, __class): the members that hold each sample, sorted; a plan's members are few."""
    return members.where("sample_id IS NOT NULL AND member IS NOT NULL").groupBy("sample_id").agg(F.array_sort(F.collect_set("member")).alias("__class"))


def leaks_by_member(samples: DataFrame, plan: DataFrame, members: DataFrame, declared: DataFrame) -> DataFrame:
    """As `leaks`, for artifacts that share their samples.

    `plan` (artifact, member) says which members each artifact was fitted on,
    `members` (member, sample_id) what they hold, `declared` (artifact, group_id)
    the group footprints.  A sample is listed once for each member and not for
    each artifact; only counts meet the plan.
    """
    held = samples.select("artifact", "sample_id").join(_classes(members), "sample_id").groupBy("artifact", "__class").agg(F.count(F.lit(1)).alias("n"))
    inside = plan.groupBy("artifact").agg(F.collect_set("member").alias("__plan"))
    alone = held.join(F.broadcast(inside), "artifact").where(F.arrays_overlap("__class", "__plan")).groupBy("artifact").agg(F.sum("n").alias("n_leaks"))
    groups = samples.groupBy("artifact", "group_id").agg(F.count(F.lit(1)).alias("n")).join(declared.distinct(), ["artifact", "group_id"], "left_semi").groupBy("artifact").agg(F.sum("n").alias("n_leaks"))
    return alone.select("artifact", F.lit("sample").alias("kind"), "n_leaks").unionByName(groups.select("artifact", F.lit("group").alias("kind"), "n_leaks"))


def consistency_by_member(samples: DataFrame, plan: DataFrame, members: DataFrame, declared: DataFrame) -> DataFrame:
    """As `footprint_consistency`, for footprints as in `leaks_by_member`."""
    known = _classes(members).join(samples.select("sample_id", "group_id"), "sample_id", "left").groupBy("__class", "group_id").agg(F.count(F.lit(1)).alias("n"))
    inside = plan.groupBy("artifact").agg(F.collect_set("member").alias("__plan"))
    mine = known.join(F.broadcast(inside), F.arrays_overlap("__class", "__plan")).groupBy("artifact", "group_id").agg(F.sum("n").alias("n"))
    joined = mine.join(declared.distinct().withColumn("__d", F.lit(1)), ["artifact", "group_id"], "left")
    unknown = F.coalesce(F.sum(F.when(F.col("group_id").isNull(), F.col("n"))), F.lit(0))
    return joined.groupBy("artifact").agg(unknown.alias("n_unknown_samples"), F.count_if(F.col("group_id").isNotNull() & F.col("__d").isNull()).alias("n_groups_not_declared"))


def role_overlap(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n_shared): values of each key that occur in more than one role."""
    out = None
    for k in keys:
        shared = samples.groupBy(k).agg(F.count_distinct("role").alias("n")).where("n > 1").agg(F.lit(k).alias("key"), F.count(F.lit(1)).alias("n_shared"))
        out = shared if out is None else out.unionByName(shared)
    return out


def temporal_isolation(samples: DataFrame) -> DataFrame:
    """(role, first_year, last_year): a test role is isolated in time if its first year is after all others' last."""
    return samples.groupBy("role").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def group_exclusion(predicted: DataFrame, used: DataFrame, locked: DataFrame, group: str = "group_id") -> DataFrame:
    """Counts that must be zero: predicted groups that were used, and used groups that are locked."""
    a = predicted.select(group).distinct().join(used.select(group).distinct(), group, "left_semi").agg(F.lit("predicted_used").alias("rule"), F.count(F.lit(1)).alias("n_violations"))
    b = used.select(group).distinct().join(locked.select(group).distinct(), group, "left_semi").agg(F.lit("used_locked").alias("rule"), F.count(F.lit(1)).alias("n_violations"))
    return a.unionByName(b)


def set_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(side, n): keys that only one of two tables holds."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return a.exceptAll(b).agg(F.lit("left_only").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(b.exceptAll(a).agg(F.lit("right_only").alias("side"), F.count(F.lit(1)).alias("n")))


def unreceipted(outputs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Outputs that are neither present nor covered by a deletion receipt of the same digest."""
    gone = outputs.where(~F.col("present"))
    return gone.join(receipts.select("path", "sha256"), ["path", "sha256"], "left_anti")


def link_violations(events: DataFrame, links: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rules of event-to-record links: ids known on both sides, each record linked once, same source."""
    e = events.select("event_id", F.col("source").alias("__event_source"))
    r = ledger.select("record_id", F.col("source").alias("__record_source"))
    joined = links.join(e, "event_id", "left").join(r, "record_id", "left")
    found = violations(joined, {
        "unknown_event": F.col("__event_source").isNull(), "unknown_record": F.col("__record_source").isNull(),
        "different_source": F.coalesce(F.col("__event_source") != F.col("__record_source"), F.lit(False)),
    })
    twice = links.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(twice.agg(F.lit("record_linked_twice").alias("rule"), F.count(F.lit(1)).alias("n_violations")))
