"""Mixing sources to target weights by entropy balancing.

Rates r(d) are chosen as near to one as possible (in relative entropy, summed
over the documents, none above `most`) while the tokens of every source, and of
any further moment that is asked for, meet their targets.  The convex dual has
one multiplier for each constraint, and its optimum is an exponential tilt by
what the document brings to the constraints:

    r(d) = min(most, exp(size * (source multiplier + sum of moment multipliers * moment(d))))

so a source that must shrink gives up its long documents first, and one that
must grow repeats them first.  Newton's method minimises the dual.  Documents
with equal constraint values are added up first; each iteration is one
distributed aggregation of that table by source (dual, tokens, curvature), and
the driver solves the block arrow system of sources and a handful of moments.
Without moments the sources part, and a step that leaves a source's bracket is
replaced by bisection; with them a step that does not lower the dual is halved.
The rates are then rounded into copies by error
diffusion, in groups of bounded size that are drawn from a source by hash: from
the largest document to the smallest, each takes the number of whole copies
that brings the group's tokens nearest to its share.

The driver holds one row for each source (a mixture's configuration), never one
for each document.

Defined results: a null text has size 0 and is taken 0 times; a null source is
a source of its own, the last in order; of equal rows each gets a number of
copies of its own, and they are dealt to many groups; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.llm._base import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that are rounded together.
GROUP = 2_000


def targets_for(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Share the total of all sizes by weight, no target above `most` times its own size."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        room = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if room * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in range(len(sizes)):
                out[i] = room * weights[i] / weight if i in open_ else most * sizes[i]
            return out
        open_ = [i for i in open_ if i not in over]
    return [most * s for s in sizes]


#: Share of the expected decrease that a step must reach; halvings of a step; share of its bound below which the curvature counts as none.
ARMIJO, HALVINGS, FLOOR = 1e-4, 40, 1e-9


def balance(table: DataFrame, targets: dict, moments: dict[str, float] | None = None, most: float = 3.0, tolerance: float = 1e-9, rounds: int = 100) -> tuple[dict, dict[str, float]]:
    """Multipliers of the sources and moments for (source, mass[, moments...]), one row for each document.

    `targets` has the tokens wanted of each source (zero: none are taken;
    `most` times all or more: all are taken `most` times), and `moments` the
    wanted sum of rate * mass * column for each named column.
    """
    names = list(moments or {})
    wanted = np.array([(moments or {})[n] for n in names], float)
    sources = list(targets)
    index = {s: i for i, s in enumerate(sources)}
    goal = np.array([targets[s] for s in sources], float)
    lines = checkpointed(table.groupBy("source", "mass", *names).agg(F.count(F.lit(1)).alias("n")))
    spark = table.sparkSession
    k = len(names)

    def sums(alpha: np.ndarray, beta: np.ndarray) -> dict[str, np.ndarray]:
        """Per source: the dual's document part, tokens, moment sums, and curvature (true, and its bound)."""
        held = spark.createDataFrame([(s, float(a)) for s, a in zip(sources, alpha)], "of string, multiplier double")
        x = F.col("mass").cast("double")
        u = x * sum((F.lit(float(b)) * F.col(n) for b, n in zip(beta, names)), F.col("multiplier"))
        top = math.log(most)
        rate = F.exp(F.least(u, F.lit(top)))
        value = rate + F.lit(most) * F.greatest(u - top, F.lit(0.0))
        unit = [F.lit(1.0), *(F.col(n) for n in names)]
        free = F.when(u < top, rate).otherwise(0.0)
        found = [F.sum(F.col("n") * value).alias("value")]
        found += [F.sum(F.col("n") * rate * x * v).alias(f"g{i}") for i, v in enumerate(unit)]
        for name, weight in (("h", free), ("b", rate)):
            found += [F.sum(F.col("n") * weight * x * x * unit[i] * unit[j]).alias(f"{name}{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
        out = {"value": np.zeros(len(sources)), "g": np.zeros((len(sources), k + 1)), "h": np.zeros((len(sources), k + 1, k + 1)), "b": np.zeros((len(sources), k + 1, k + 1))}
        for r in lines.join(held, F.col("source").eqNullSafe(F.col("of"))).groupBy("source").agg(*found).collect():
            s = index[r["source"]]
            out["value"][s] = r["value"]
            out["g"][s] = [r[f"g{i}"] for i in range(k + 1)]
            for name in ("h", "b"):
                out[name][s] = [[r[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]
        return out

    # At the multiplier log(most) every document of at least one token is at the cap.
    size = {r["source"]: float(r["m"]) for r in lines.groupBy("source").agg(F.sum(F.col("n") * F.col("mass")).alias("m")).collect()}
    full = np.array([goal[i] >= most * size.get(s, 0.0) * (1 - 1e-12) for i, s in enumerate(sources)], bool)
    live = (goal > 0) & ~full
    alpha, beta = np.where(full, 1e3, np.where(live, 0.0, -1e3)), np.zeros(k)
    scale = max(1.0, goal.sum())

    def dual(at: dict, alpha: np.ndarray, beta: np.ndarray) -> float:
        return float((at["value"] - np.where(live, alpha * goal, 0.0)).sum() - beta @ wanted)

    # Without moments each source has a bracket: documents have at least one token.
    share_of = np.array([goal[i] / size[s] if size.get(s) else 1.0 for i, s in enumerate(sources)])
    low, high = np.where(live, np.log(np.clip(share_of, 1e-300, 1.0)), 0.0), np.full(len(sources), math.log(most))
    at = sums(alpha, beta)
    for _ in range(rounds):
        miss_s = np.where(live, goal - at["g"][:, 0], 0.0)
        miss_m = wanted - at["g"][:, 1:].sum(axis=0)
        if np.abs(miss_s).max(initial=0) <= tolerance * scale and np.abs(miss_m).max(initial=0) <= tolerance * max(scale, np.abs(wanted).max(initial=0)):
            break
        if not k:
            low, high = np.where(live & (miss_s > 0), alpha, low), np.where(live & (miss_s < 0), alpha, high)
            slope = at["h"][:, 0, 0]
            newton = alpha + np.where(slope > 0, miss_s / np.where(slope > 0, slope, 1.0), np.inf)
            stepped = np.where((low < newton) & (newton < high), newton, (low + high) / 2)
            alpha = np.where(live & (miss_s != 0), stepped, alpha)
            at = sums(alpha, beta)
            continue
        # Where nearly all documents are at the cap, the bound of the curvature keeps the step finite.
        curved = at["h"] + np.where(at["h"][:, 0, 0] < FLOOR * at["b"][:, 0, 0], 1.0, 0.0)[:, None, None] * at["b"]
        main = curved[:, 0, 0]
        inverse = np.where(live & (main > 0), 1 / np.where(main > 0, main, 1), 0.0)
        cross = curved[:, 0, 1:]
        schur = curved[:, 1:, 1:].sum(axis=0) - np.einsum("si,s,sj->ij", cross, inverse, cross)
        step_m = np.linalg.lstsq(schur, miss_m - cross.T @ (inverse * miss_s), rcond=None)[0]
        step_s = inverse * (miss_s - cross @ step_m)
        gain, now, share = step_s @ miss_s + step_m @ miss_m, dual(at, alpha, beta), 1.0
        for _ in range(HALVINGS):
            trial = sums(alpha + share * step_s, beta + share * step_m)
            if dual(trial, alpha + share * step_s, beta + share * step_m) <= now - ARMIJO * share * gain + 1e-12 * (1 + abs(now)):
                break
            share /= 2
        alpha, beta, at = alpha + share * step_s, beta + share * step_m, trial
    return dict(zip(sources, np.where(goal > 0, alpha, -math.inf).tolist())), dict(zip(names, beta.tolist()))


def round_to_copies(size: np.ndarray, rate: np.ndarray, most: int) -> np.ndarray:
    """Copies of each document, given in the order in which they are rounded."""
    out = np.zeros(len(size), np.int64)
    owed = 0.0
    for i, (s, r) in enumerate(zip(size.tolist(), rate.tolist())):
        owed += s * r
        if s:
            out[i] = min(most, max(0, math.floor(owed / s + 0.5)))
            owed -= s * int(out[i])
    return out


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", moments: dict[str, tuple[Column, float]] | None = None, digest: bool = False) -> DataFrame:
    """(id, size, source, source_size, target, rate, copies) for every document, with the text's MD5 if `digest` is set.

    Sources in code point order, null last, take the weights in turn; targets
    share the total size and stop at `most` times the source's own.  `moments`
    adds constraints: a named expression of the document and the wanted mean of
    it over the mixed tokens.
    """
    extra = moments or {}
    named = ["digest"] if digest else []
    sized = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.col(source).cast("string").alias("source"),
        _size(text).alias("size"),
        *[c.cast("double").alias(n) for n, (c, _) in extra.items()],
        *[_digest(text).alias(n) for n in named],
    )
    sized = checkpointed(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in totals]
    targets = targets_for(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    alpha, beta = balance(
        sized.where("size > 0").withColumnRenamed("size", "mass"),
        {r["source"]: t for r, t in zip(totals, targets) if r["size"]},
        {n: mean * sum(targets) for n, (_, mean) in extra.items()},
        most,
    )
    rows = [(r["source"], s, float(t), alpha.get(r["source"], -math.inf), max(1, -(-r["n"] // GROUP))) for r, s, t in zip(totals, sizes, targets)]
    # One row for each source: Spark broadcasts it where it is small and shuffles it where it is not.
    spec = docs.sparkSession.createDataFrame(rows, "of string, source_size long, target double, base double, parts long")
    tilt = sum((F.lit(b) * F.col(n) for n, b in beta.items()), F.col("base"))
    # Equal rows are counted first and dealt to the groups by the thousand, so none is hot.
    equal = sized.groupBy("id", "size", "source", *extra, *named).agg(F.count(F.lit(1)).alias("n"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP))))
    lots = lots.withColumn("n", F.least(F.col("n") - F.col("lot") * GROUP, F.lit(GROUP)))
    rated = lots.join(spec, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "size", "source", "source_size", "target",
        F.when(F.col("size") > 0, F.exp(F.least(F.col("size") * tilt, F.lit(math.log(most))))).otherwise(0.0).alias("rate"),
        F.pmod(F.xxhash64("id", "size", "lot"), "parts").alias("part"), "n", *named,
    )

    def give(table):
        order = table.sort_by([("size", "descending"), ("id", "ascending"), ("rate", "ascending"), *((n, "ascending") for n in named)])
        order = order.take(pa.array(np.repeat(np.arange(len(order)), order.column("n").to_numpy())))
        copies = round_to_copies(order.column("size").to_numpy(), order.column("rate").to_numpy(), most)
        return order.drop_columns(["part", "n"]).append_column("copies", pa.array(copies))

    return rated.groupBy(F.col("source"), F.col("part")).applyInArrow(give, "id long, size long, source string, source_size long, target double, rate double, " + "".join(f"{n} string, " for n in named) + "copies long")


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def materialise(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with its own columns only.

    `mixed` is the answer of `mix` with `digest`.  Rows are matched by id, text
    and source (null matches null).  Rows that agree in all three share their
    copies evenly; the first of them, in order of partition, take one that is left.
    """
    names = docs.columns
    key = ["__id", "__digest", "__source"]
    taken = mixed.groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("source").alias("__source")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0")
    keyed = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__digest": _digest(text), "__source": F.col(source).cast("string")})

    def matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"{k}_of" for k in on})
        same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in on]
        return left.join(renamed, same).drop(*(f"{k}_of" for k in on))

    joined = matched(keyed, taken, key)
    once = joined.where("__rows = 1").withColumn("__share", F.col("__copies"))
    # Equal rows are numbered inside their partitions, whose counts give each partition's first number.
    often = checkpointed(joined.where("__rows > 1").withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftrightunsigned("__at", 33))
    counts = often.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__at"))
    numbered = matched(often, starts, [*key, "__part"]).withColumn("__place", place)
    shared = numbered.withColumn("__share", F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__place") <= F.col("__copies") % F.col("__rows")).cast("long"))
    every = once.select(*names, "__share").unionByName(shared.select(*names, "__share")).where("__share > 0")
    return every.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__share").cast("long")))).select(*names)
