"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text only.  A symbol is a character: code points
below 3838 are symbols of their own, the rest share 256 classes, so an n-gram of
five is one 60-bit integer, its context a shift and its lower order a mask.
Counts, continuation counts, context totals and interpolated probabilities are
tables that Spark joins and aggregates, sharded by n-gram.

Scoring: each chunk of documents sends its distinct n-grams to the shards (one
delta-coded blob for each shard), the shards' distinct n-grams are joined with
the model order by order, and each chunk gets the logarithms back and adds them
up for its documents.  What is gathered grows with the corpus.

A document's score is its mean negative log-likelihood, drawn towards its
language's mean by `PRIOR` symbols, so that short texts are not judged on chance.
A language's threshold is a quantile of the scores of trusted documents that the
counts did not see; languages without such documents take the quantile of all.

Defined results: a null or empty text has no symbols, a null perplexity, and is
not kept; a null language is a language of its own; a null id is scored and never
trusted; repeated rows score alike; without trusted text every symbol is equally
likely and nothing is rejected but empty texts; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.llm._base import checkpointed, deltas, pack_arrays, slices, to_chunks, undelta, unpack_arrays, unpack_table

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
BEGIN, END = 0, 1
#: Symbols of the language's mean that are added to each document.
PRIOR = 50
#: Text bytes of a chunk and of the parts it is worked through in; n-grams that a counting task holds.
LM_CHUNK_BYTES = 16 << 20
PART_BYTES = 4 << 20
HELD = 2_000_000
#: Bytes of trusted ids up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, owner, sizes): the n-gram that ends at each symbol (the end mark included), and its text."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    begin = np.zeros(ORDER - 1, np.uint32)
    end = np.array([END], np.uint32)
    for i, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        parts += [begin, np.where(points < 3838, points + 2, 3840 + (points & 255)), end]
        sizes[i] = len(points) + 1
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), sizes
    stream = np.concatenate(parts).astype(np.uint64)
    grams = stream.copy()
    for back in range(1, ORDER):
        grams[back:] |= stream[:-back] << np.uint64(BITS * back)
    return grams[stream != BEGIN], np.repeat(np.arange(len(texts)), sizes), sizes


def count(texts: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram of the highest order occurs in the column `text`."""

    def run(batches):
        held, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for table in slices(batches, "text", PART_BYTES):
            grams, _, _ = symbols([t.as_py().encode() if t.is_valid else None for t in table.column("text")])
            found, k = np.unique(grams, return_counts=True)
            merged, place = np.unique(np.concatenate([held, found]), return_inverse=True)
            held, n = merged, np.bincount(place, weights=np.concatenate([n, k]), minlength=len(merged)).astype(np.int64)
            if len(held) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(n)], names=["gram", "n"])
                held, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(n)], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _mask(order: int) -> Column:
    return F.lit((1 << BITS * order) - 1)


def discounts(found: dict[int, int]) -> list[float]:
    """D1, D2 and D3+ from how many n-grams have a count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (found.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(v, 0.05), k) for k, v in ((0.95, 1 - 2 * y * n2 / n1), (1.95, 2 - 3 * y * n3 / n2), (2.95, 3 - 4 * y * n4 / n3 if n3 else 1.5))]


class Model:
    """Tables of each order: `prob` (gram, p) of seen n-grams, `back` (context, weight) of seen contexts."""

    def __init__(self, counts: DataFrame):
        """From (gram, n) of the highest order; the tables are checkpointed."""
        tables = {ORDER: checkpointed(counts)}
        for order in range(ORDER - 1, 0, -1):
            # Kneser-Ney: a lower order counts the different n-grams it ends.
            tables[order] = checkpointed(tables[order + 1].groupBy(F.col("gram").bitwiseAND(_mask(order)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        self.prob: dict[int, DataFrame] = {}
        self.back: dict[int, DataFrame] = {}
        for order in range(1, ORDER + 1):
            rows = tables[order]
            d = discounts({r["n"]: r["k"] for r in rows.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()})
            cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            rows = rows.select("gram", F.shiftright("gram", BITS).alias("context"), "n", cut.alias("cut"))
            back = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
            joined = rows.join(back, "context").withColumn("own", (F.col("n") - F.col("cut")) / F.col("total"))
            if order == 1:
                p = joined.select("gram", (F.col("own") + F.col("weight") / SYMBOLS).alias("p"))
            else:
                lower = self.prob[order - 1].select(F.col("gram").alias("lower"), F.col("p").alias("q"))
                p = joined.join(lower, F.col("gram").bitwiseAND(_mask(order - 1)) == F.col("lower")).select("gram", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
            self.prob[order], self.back[order] = checkpointed(p), checkpointed(back.select("context", "weight"))

    def resolve(self, grams: DataFrame) -> DataFrame:
        """(gram, logp) of distinct n-grams of the highest order, seen or not."""
        wanted = {ORDER: grams.select("gram")}
        for order in range(ORDER - 1, 0, -1):
            wanted[order] = wanted[order + 1].select(F.col("gram").bitwiseAND(_mask(order)).alias("gram")).distinct()
        below: DataFrame | None = None
        for order in range(1, ORDER + 1):
            rows = wanted[order].join(self.prob[order], "gram", "left").withColumn("context", F.shiftright("gram", BITS)).join(self.back[order], "context", "left")
            weight = F.coalesce("weight", F.lit(1.0))
            if below is None:
                rows = rows.select("gram", F.coalesce("p", weight / SYMBOLS).alias("p"))
            else:
                lower = below.select(F.col("gram").alias("lower"), F.col("p").alias("q"))
                rows = rows.withColumn("lower", F.col("gram").bitwiseAND(_mask(order - 1))).join(lower, "lower").select("gram", F.coalesce("p", weight * F.col("q")).alias("p"))
            below = rows
        return below.select("gram", F.ln("p").alias("logp"))


def _parts(body: bytes):
    """A chunk in parts of bounded size: (table, owner, sizes, distinct n-grams, number of each n-gram)."""
    for table in slices(iter(unpack_table(body).to_batches(max_chunksize=1000)), "text", PART_BYTES):
        grams, owner, sizes = symbols([t.as_py().encode() if t.is_valid else None for t in table.column("text")])
        coded = pa.array(grams).dictionary_encode()
        yield table, owner, sizes, coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _deal(distinct: np.ndarray, shards: int):
    """(shard, n-grams) of ascending distinct n-grams, ascending within each shard."""
    shard = (distinct % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    cut = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]
    for s in range(shards):
        if cut[s] < cut[s + 1]:
            yield s, by[cut[s] : cut[s + 1]]


def _prime(least: int) -> int:
    """The smallest odd prime from `least` on: the last symbols alone then don't decide an n-gram's shard."""
    n = max(3, least | 1)
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, lang, n, nll): symbols of each document and its negative log-likelihood, from (id, lang, text)."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = _prime(max(64, size >> 25))
    chunks = to_chunks(docs, ["id", "lang", "text"], "text", LM_CHUNK_BYTES, gather=True)

    def send(batches):
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                distinct = np.unique(np.concatenate([d for _, _, _, d, _ in _parts(body.as_py())]))
                parts = [(s, pack_arrays(gram=deltas(distinct[at]))) for s, at in _deal(distinct, shards)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([b for _, b in parts], pa.binary())], names=["shard", "chunk", "body"])

    sent = chunks.mapInArrow(send, "shard long, chunk long, body binary")

    def union(key, table):
        grams = np.unique(np.concatenate([undelta(unpack_arrays(b.as_py())["gram"]) for b in table.column("body")]))
        return pa.table({"gram": pa.array(grams.astype(np.int64))})

    distinct = sent.groupBy("shard").applyInArrow(union, "gram long")
    known = model.resolve(distinct).withColumn("shard", F.col("gram") % shards)

    def answer(key, left, right):
        right = right.combine_chunks()
        grams = right.column("gram").to_numpy() if right.num_rows else np.empty(0, np.int64)
        order = np.argsort(grams)
        grams, logp = grams[order].astype(np.uint64), (right.column("logp").to_numpy()[order].astype(np.float32) if len(order) else np.empty(0, np.float32))
        bodies = [pack_arrays(logp=logp[np.searchsorted(grams, undelta(unpack_arrays(b.as_py())["gram"]))]) for b in left.column("body")]
        return pa.table({"chunk": left.column("chunk"), "shard": left.column("shard"), "body": pa.array(bodies, pa.binary())})

    answers = sent.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "chunk long, shard long, body binary")

    def add_up(key, left, right):
        if not left.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "nll": pa.array([], pa.float64())})
        got = dict(zip(right.column("shard").to_pylist(), right.column("body")))
        body, out = left.column("body")[0].as_py(), []
        every = np.unique(np.concatenate([d for _, _, _, d, _ in _parts(body)]))
        logp = np.zeros(len(every), np.float64)
        for s, at in _deal(every, shards):
            logp[at] = unpack_arrays(got[s].as_py())["logp"]
        for table, owner, sizes, distinct, number in _parts(body):
            mine = logp[np.searchsorted(every, distinct)]
            total = -np.bincount(owner, weights=mine[number], minlength=len(sizes)).astype(np.float64)
            out.append(pa.table({"id": table.column("id"), "lang": table.column("lang"), "n": pa.array(sizes), "nll": pa.array(total)}))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, "id long, lang string, n long, nll double")


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    """(lang, mean, most) of held-out trusted documents: the mean and the quantile of their scores, by language.

    Scores are counted in steps of 1/1000 nat before the quantile is taken, so
    a language of any size is summed in counts.  The row whose `any` is true is
    for all languages together.
    """
    mean = scores.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    overall = scores.agg((F.sum("nll") / F.sum("n")).alias("mean"))
    named = mean.select(F.col("lang").alias("l"), "mean")
    drawn = scores.join(named, F.col("lang").eqNullSafe(F.col("l"))).select("lang", _drawn(F.col("mean")).alias("score"))
    steps = drawn.groupBy("lang", F.ceil(F.col("score") * 1000).alias("step")).agg(F.count(F.lit(1)).alias("k"))
    marked = steps.select("lang", F.lit(False).alias("any"), "step", "k").unionByName(
        steps.groupBy("step").agg(F.sum("k").alias("k")).select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("any"), "step", "k")
    )
    w = Window.partitionBy("any", "lang")
    below = F.sum("k").over(w.orderBy("step"))
    most = marked.withColumns({"below": below, "all": F.sum("k").over(w)}).where(F.col("below") >= F.lit(quantile) * F.col("all")).groupBy("any", "lang").agg((F.min("step") / 1000).alias("most"))
    means = mean.select("lang", F.lit(False).alias("any"), "mean").unionByName(overall.select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("any"), "mean"))
    m = means.select(F.col("lang").alias("l"), F.col("any").alias("a"), "mean")
    return most.join(m, (F.col("any") == F.col("a")) & F.col("lang").eqNullSafe(F.col("l"))).select("lang", "any", "mean", "most")


def _drawn(mean: Column) -> Column:
    return (F.col("nll") + mean * PRIOR) / (F.col("n") + PRIOR)


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.98, holdout: float = 0.25, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, n_symbols, perplexity, score, threshold, kept) for every document.

    `trusted` holds ids (column `id`).  A share of `holdout` of them, by hash,
    sets the thresholds; the others are counted.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    held = F.pmod(F.xxhash64(F.lit("holdout"), "id"), F.lit(1000)) < int(holdout * 1000)
    ids = checkpointed(trusted.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct().withColumn("held", held))
    counted = ids.where("NOT held").select("id")
    if ids.count() * 16 <= BROADCAST_BYTES:
        counted = F.broadcast(counted)  # beyond the bound Spark shuffles both sides
    model = Model(count(named.join(counted, "id", "left_semi")))
    scores = checkpointed(score(named, model))
    known = scores.where("n > 0").join(ids.where("held"), "id", "left_semi")
    limits = checkpointed(thresholds(known, quantile))
    own = limits.where("NOT any").select(F.col("lang").alias("l"), "mean", "most")
    every = limits.where("any").select(F.col("mean").alias("mean_any"), F.col("most").alias("most_any"))
    joined = scores.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(every), how="left")  # one row
    drawn = _drawn(F.coalesce("mean", "mean_any", F.lit(math.log(SYMBOLS))))
    limit = F.coalesce("most", "most_any")
    some = F.col("n") > 0
    return joined.select(
        "id", "lang", F.col("n").alias("n_symbols"),
        F.when(some, F.exp(F.col("nll") / F.greatest("n", F.lit(1)))).alias("perplexity"),
        F.when(some, drawn).alias("score"), limit.alias("threshold"),
        (some & F.coalesce(drawn <= limit, F.lit(True))).alias("kept"),
    )
