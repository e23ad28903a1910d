"""Exact top-k inner products over integer vectors.

Candidates are searched from the longest to the shortest.  Vectors are rotated
by the singular vectors of a sample, so the first coordinates carry most of
the length; for a pair, the product of the first coordinates plus the product
of the two remaining lengths (Cauchy-Schwarz) bounds the whole product.  A
candidate whose bound is below a query's k-th best score is dropped, and once
the product of lengths is below it for all queries the search ends.  What is
left is scored with exact integers.

The rotation and the first thresholds come from a bounded sample of the
candidates (`SAMPLE` rows, those with the least id hashes); any orthogonal
matrix and any lower bounds give the same result.  Queries are held in blocks
of bounded size and each block is searched against every candidate partition.

Defined results: vectors that are null, or hold a null or a non-finite
component, take no part; a shorter vector counts as padded with zeros; an empty
vector has score 0 with all; scores beyond 64 bits are held at the limit; ties
go to the smaller id, null ids last; a candidate with the query's id is its own
and left out; each query row is answered by itself, so two vectors with one id give
two answers under it, and equal rows (id and vector) one; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.llm._base import checkpointed

SAMPLE = 4096
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 1024
#: Integers up to here have exact products and sums in doubles for any usual length.
SMALL = 1 << 20
_LIMIT = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(id, body): floor(scale * x) of each component as 64-bit integers; invalid vectors are left out."""

    def run(batches):
        for batch in batches:
            ids, bodies = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not v.is_valid:
                    continue
                values = v.values
                if values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                bodies.append(np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], names=["id", "body"])

    chosen = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, "id long, body binary")


def matrix(bodies: list, width: int) -> np.ndarray:
    out = np.zeros((len(bodies), width), np.int64)
    for i, b in enumerate(bodies):
        out[i, : len(b) // 8] = np.frombuffer(b, np.int64)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows a[i] . b[i]."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= SMALL and a.shape[1] <= 1 << 12:
        return np.einsum("ij,ij->i", a, b)
    exact = [sum(x * y for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]
    return np.array([max(-_LIMIT - 1, min(_LIMIT, s)) for s in exact], np.int64).reshape(len(exact))


def _best(query: np.ndarray, ident: np.ndarray, null: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query: highest score, then smallest id, null ids last."""
    order = np.lexsort((ident, null, -score.astype(np.float64), query)) if np.abs(score).max(initial=0) < 1 << 53 else np.lexsort((ident, null, ~score, query))
    query = query[order]
    first = np.r_[True, query[1:] != query[:-1]]
    place = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = order[place < k]
    return keep


class Search:
    """The queries of a block, rotated, with their thresholds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, head: int, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.rotation, self.head, self.k = ids, vectors, rotation, head, k
        turned = vectors.astype(np.float64) @ rotation
        self.front = turned[:, :head]
        self.rest = np.linalg.norm(turned[:, head:], axis=1)
        self.length = np.linalg.norm(turned, axis=1)
        self.floor = floor.astype(np.float64).copy()

    def run(self, ids: np.ndarray, null: np.ndarray, vectors: np.ndarray):
        """(query row, id, null, score) of the best candidates among the given rows."""
        turned = vectors.astype(np.float64) @ self.rotation
        length = np.linalg.norm(turned, axis=1)
        order = np.argsort(-length, kind="stable")
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)]
        for start in range(0, len(order), CANDIDATE_BLOCK):
            block = order[start : start + CANDIDATE_BLOCK]
            longest = length[block[0]]
            slack = 1e-9 * self.length * longest + 1e-3
            live = np.flatnonzero(self.length * longest + slack >= self.floor)
            if not len(live):
                break  # all later candidates are shorter
            front, rest = turned[block, : self.head], np.linalg.norm(turned[block, self.head :], axis=1)
            for a in range(0, len(live), 2048):
                q = live[a : a + 2048]
                bound = self.front[q] @ front.T + self.rest[q, None] * rest[None, :]
                i, j = np.nonzero(bound + slack[q, None] >= self.floor[q, None])
                rows, cand = q[i], block[j]
                other = null[cand] | (ids[cand] != self.ids[rows])
                rows, cand = rows[other], cand[other]
                if not len(rows):
                    continue
                score = np.concatenate([products(self.vectors[rows[s : s + 65536]], vectors[cand[s : s + 65536]]) for s in range(0, len(rows), 65536)])
                good = score >= self.floor[rows]
                merged = [np.concatenate([x, y]) for x, y in zip(found, (rows[good], ids[cand[good]], null[cand[good]], score[good]))]
                keep = _best(*merged, self.k)
                found = [x[keep] for x in merged]
                full = np.bincount(found[0], minlength=len(self.ids)) >= self.k
                worst = np.full(len(self.ids), np.inf)
                np.minimum.at(worst, found[0], found[3].astype(np.float64))
                self.floor = np.where(full, np.maximum(self.floor, worst), self.floor)
        return found


def top_products(vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", is_query: Column | None = None, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products with other rows.

    `is_query` selects the queries by the column `id`; by default every row is one.
    """
    spark = vectors.sparkSession
    rows = checkpointed(quantised(vectors, vec_id, embedding, scale))
    width = (rows.agg(F.max(F.octet_length("body")).alias("n")).first()["n"] or 0) // 8
    seed = rows.orderBy(F.xxhash64("id", "body"), "id").limit(SAMPLE).collect()
    sample = matrix([r["body"] for r in seed], width)
    rotation = np.linalg.svd(sample.astype(np.float64).T @ sample.astype(np.float64))[0] if width and len(sample) else np.eye(width)
    energy = np.cumsum(((sample @ rotation) ** 2).sum(axis=0)) if len(sample) else np.zeros(width)
    # The fewest coordinates with half of the sample's squared length, at most half of all.
    head = int(min(max(1, np.searchsorted(energy, energy[-1] / 2) + 1), max(1, width // 2))) if width else 0
    seed_ids = np.array([0 if r["id"] is None else r["id"] for r in seed], np.int64)
    seed_null = np.array([r["id"] is None for r in seed], bool)
    wanted = rows.where(F.col("id").isNotNull() & (is_query if is_query is not None else F.lit(True))).distinct()

    def search(ids: np.ndarray, queries: np.ndarray) -> DataFrame:
        floor = np.full(len(ids), -np.inf)
        first = Search(ids, queries, rotation, head, floor, k)
        first.run(seed_ids, seed_null, sample)
        shared = spark.sparkContext.broadcast((ids, queries, rotation, head, first.floor))
        number = len(parts)

        def scan(batches):
            held_ids, held_null, bodies = [], [], []
            for batch in batches:
                column = batch.column(0)
                held_ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                held_null.append(column.is_null().to_numpy(zero_copy_only=False))
                bodies += batch.column(1).to_pylist()
            if not bodies:
                return
            q_ids, q, turn, front, low = shared.value
            query, ident, null, score = Search(q_ids, q, turn, front, low, k).run(np.concatenate(held_ids), np.concatenate(held_null), matrix(bodies, width))
            yield pa.RecordBatch.from_arrays([pa.array(query + (number << 32)), pa.array(q_ids[query]), pa.array(ident, mask=null), pa.array(score)], names=["query", "query_id", "id", "score"])

        return rows.mapInArrow(scan, "query long, query_id long, id long, score long")

    parts, ids, bodies = [], [], []

    def flush() -> None:
        if ids:
            parts.append(checkpointed(search(np.array(ids, np.int64), matrix(bodies, width))))
            ids.clear()
            bodies.clear()

    for r in wanted.toLocalIterator():  # one block of queries is on the driver at a time
        ids.append(r["id"])
        bodies.append(bytes(r["body"]))
        if len(ids) >= QUERY_BLOCK:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "id", "score").where(F.col("rank") <= k)


