"""Importance resampling of documents towards a target text distribution, in DataFrame functions only.

Every text becomes hashed word n-grams: runs of 1 to `most` words, CRC-32 modulo
`buckets`.  A bucket's gain is the log ratio of its smoothed share in the target
texts to its share in all documents; a document's weight is the sum of gains
over its features.  Gumbel noise that depends on the seed and the id only makes
the highest scores a sample without replacement in proportion to exp(weight).

The gain table has `buckets` rows whatever the input (`MOST_BUCKETS` bounds it),
so it is broadcast.  Features are counted by partition before they are
shuffled, and a document's sum leaves its partition as one row.  Ranks come
from a range-partitioned sort: each partition's rows are numbered in place and
shifted by the sizes of the partitions before it.

Defined results: a null text has no words, hence weight 0; a null id draws the
noise of an empty id, and is last among ties; rows that repeat id and text have
the same score and ranks of their own; an empty table gives an empty result,
an empty target the gains of the smoothing alone; further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.llm._base import checkpointed

#: A word: letters a to z, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the broadcast gain table at most (12 bytes each).
MOST_BUCKETS = 1 << 20
#: Rows that one range of the sort is to hold, about.
RANGE_ROWS = 500_000
#: Copies of one row that are numbered from one array.
COPIES = 1_000


def words(text: Column | str) -> Column:
    """The words of a text after lower-casing A-Z; none for null."""
    lower = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def ngrams(found: Column, most: int) -> Column:
    """All runs of 1 to `most` consecutive words, joined by one space."""
    if most == 1:
        return found

    def runs(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return F.concat(found, *(runs(n) for n in range(2, most + 1)))


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, text: str, most: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket; at most `buckets` rows leave a partition."""
    features = texts.select(F.explode(ngrams(words(text), most)).alias("feature"))
    return features.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, most: int, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket, in thousandths."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")
    source = bucket_counts(docs, text, most, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, target_text, most, buckets).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    counted = every.join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0, ["s", "t"])
    totals = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return counted.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row of totals


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 of `seed:id`."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def weights(docs: DataFrame, gain: DataFrame, doc_id: str, text: str, most: int, buckets: int) -> DataFrame:
    """(id, digest, n_words, n_features, weight, copies): one row for each different pair of id and text."""
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), words(text).alias("words"))
    features = found.select("id", "digest", F.size("words").alias("n"), F.posexplode_outer(ngrams(F.col("words"), most)).alias("place", "feature"))
    gained = features.withColumn("bucket", bucket(F.col("feature"), buckets)).join(F.broadcast(gain), "bucket", "left")
    summed = gained.groupBy("id", "digest").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count("feature").alias("features"),
        F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"),
        # One row of a document is its first feature, or its only row without one.
        F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("copies"),
    )
    return summed.select("id", "digest", "n_words", (F.col("features") / F.col("copies")).cast("long").alias("n_features"), F.expr("gain div copies").alias("weight"), "copies")


def ranked(rows: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with `rank` 1, 2, 3... in the order, without a task that sees them all.

    Rows are dealt to ranges of the order and sorted there; the ranges' sizes
    (one row for each partition) give each range's first rank.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # A monotonically increasing id holds the partition and the place in it; the checkpoint fixes both.
    placed = checkpointed(dealt.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftrightunsigned("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__at") - F.shiftleft("__part", 33)
    return placed.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__start") + place + 1).drop("__at", "__part", "__start")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; `rank` is null for those not drawn.

    Of the documents with `least_words` words or more, `percent` of a hundred
    (rounded down) with the highest scores are drawn, ties to the smaller id.
    """
    gain = checkpointed(gains(docs, target, text, target_text, most, buckets))
    summed = checkpointed(weights(docs, gain, doc_id, text, most, buckets).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    single = summed.withColumn("lot", lots).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("lot") * COPIES))))
    able = single.where(F.col("n_words") >= least_words)
    drawn = (summed.where(F.col("n_words") >= least_words).agg(F.sum("copies").alias("n")).first()["n"] or 0) * percent // 100
    columns = ["id", "n_words", "n_features", "weight", "score"]
    placed = ranked(able.select(*columns, "digest", "lot", "copy"), [F.desc("score"), F.asc_nulls_last("id"), F.asc("digest"), F.asc("lot"), F.asc("copy")])
    rest = single.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rest)
