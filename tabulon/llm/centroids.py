"""Centroid clustering with heap-ordered bounds: only vectors whose lead may be used up are looked at again.

A vector's lead is the distance to the second nearest centroid less that to its own.  Each cluster of a block of vectors
keeps a min-heap of leads, raised by the cluster's drift at the time of the entry.  When centroids move, a cluster's drift
grows by its own move plus the largest move of any other, which is the most that a lead can have shrunk.  An entry whose
key is not above the drift is popped and its vector scanned against all centroids, exactly, in integers; all others keep
their cluster unseen, and a heap whose root holds is not even unpacked.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import BucketedTables, in_python, written

BLOCK_ROWS = 1024  # vectors whose heaps are kept together
LARGEST = 1 << 27  # of a scaled component: squared distances of up to 256 such components stay within 64 bits
SLACK = 1e-12  # relative error allowed for in square roots and their sums

STATE = ("block long, ends binary, keys binary, members binary, scanned long, "
         "deltas array<struct<cluster: int, n: long, total: array<long>>>")


@dataclass
class Clustering:
    """``rows``: ``id, cluster, distance`` per vector; ``centroids``: k x width; ``scanned``: vectors scanned in each round."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def scaled_vectors(df: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """``id, no_id, v``: components as floor(scale * x), x as double; only vectors of ``width`` components, none null or non-finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    too_large = F.exists(whole, lambda c: F.abs(c) > F.lit(LARGEST))
    refuse = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) == width) & ~bad).select(
        F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("id"), F.col(key).isNull().alias("no_id"),
        F.when(too_large, refuse.cast("array<int>")).otherwise(whole.cast("array<int>")).alias("v"))


def _blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low in range(0, len(batch), rows):
            part = batch.iloc[low : low + rows]
            yield pd.DataFrame({
                "block": [uuid.uuid4().int >> 65], "n": [len(part)], "ids": [part.id.to_numpy(np.int64).tobytes()],
                "no_id": [part.no_id.to_numpy(bool).tobytes()], "vectors": [np.stack(part.v.to_list()).astype("<i4").tobytes()],
            })


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances: in doubles where every sum stays below 2**53, else in 64-bit integers, centroid by centroid."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    x = x.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the smaller number), and the least that its lead over the second can be."""
    d = distances(x, centroids)
    own = d.argmin(axis=1)
    row = np.arange(len(x))
    first = np.sqrt(d[row, own].astype(np.float64))
    if len(centroids) == 1:
        return own, np.full(len(x), np.inf)
    d[row, own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64))
    return own, second * (1 - SLACK) - first * (1 + SLACK)


class Heaps:
    """The heaps of one block: entries ``(key, member)`` of cluster j in heap order at ``ends[j]`` to ``ends[j + 1]``."""

    def __init__(self, k: int, ends: bytes | None, keys: bytes | None, members: bytes | None):
        self.k = k
        self.ends = np.zeros(k + 1, np.int32) if ends is None else np.frombuffer(ends, np.int32)
        self.keys = np.zeros(0) if keys is None else np.frombuffer(keys, np.float64)
        self.members = np.zeros(0, np.int32) if members is None else np.frombuffer(members, np.int32)
        self.open: dict[int, list[tuple[float, int]]] = {}

    def entries(self, j: int) -> list[tuple[float, int]]:
        if j not in self.open:
            part = slice(self.ends[j], self.ends[j + 1])
            self.open[j] = list(zip(self.keys[part].tolist(), self.members[part].tolist()))
        return self.open[j]

    def pop_expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members whose lead may be used up, and the cluster that each was in."""
        members, clusters = [], []
        roots = np.flatnonzero(self.ends[1:] > self.ends[:-1])
        limit = drift + 1e-9 * (1 + drift)
        for j in roots[self.keys[self.ends[roots]] <= limit[roots]].tolist():
            heap = self.entries(j)
            while heap and heap[0][0] <= limit[j]:
                members.append(heapq.heappop(heap)[1])
                clusters.append(j)
        return np.array(members, np.int64), np.array(clusters, np.int64)

    def push(self, clusters: np.ndarray, keys: np.ndarray, members: np.ndarray) -> None:
        for j, key, member in zip(clusters.tolist(), keys.tolist(), members.tolist()):
            heapq.heappush(self.entries(j), (key, member))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        sizes, keys, members = [], [], []
        for j in range(self.k):
            part = slice(self.ends[j], self.ends[j + 1])
            k, m = (np.array(x) for x in zip(*self.open[j])) if self.open.get(j) else (self.keys[part], self.members[part])
            if j in self.open and not self.open[j]:
                k, m = k[:0], m[:0]
            sizes.append(len(k))
            keys.append(k.astype(np.float64))
            members.append(m.astype(np.int32))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return ends.tobytes(), np.concatenate(keys).tobytes(), np.concatenate(members).tobytes()

    def clusters(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        owner = np.repeat(np.arange(self.k), np.diff(self.ends))
        out[self.members] = owner
        for j, heap in self.open.items():
            out[[m for _, m in heap]] = j
        return out


def _step(row, centroids: np.ndarray, drift: np.ndarray, start: bool) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bring the heaps of a block up to date: heaps, vectors, and for each scanned member the clusters before (-1: none) and now."""
    x = np.frombuffer(row.vectors, "<i4").reshape(row.n, -1)
    if start:
        heaps = Heaps(len(centroids), None, None, None)
        member, before = np.arange(row.n), np.full(row.n, -1)
    else:
        heaps = Heaps(len(centroids), row.ends, row.keys, row.members)
        member, before = heaps.pop_expired(drift)
    now = before
    if len(member):
        now, lead = nearest(x[member], centroids)
        heaps.push(now, lead + drift[now], member)
    return heaps, x, member, before, now


def _round(batches: Iterator[pd.DataFrame], centroids: np.ndarray, drift: np.ndarray, start: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            heaps, x, member, before, now = _step(row, centroids, drift, start)
            moved = np.flatnonzero(before != now)
            n = np.zeros(len(centroids), np.int64)
            total = np.zeros(centroids.shape, np.int64)
            if len(moved):
                vectors = x[member[moved]].astype(np.int64)
                np.add.at(n, now[moved], 1)
                np.add.at(total, now[moved], vectors)
                left = before[moved] >= 0
                np.subtract.at(n, before[moved][left], 1)
                np.subtract.at(total, before[moved][left], vectors[left])
            touched = np.union1d(now[moved], before[moved][before[moved] >= 0]).astype(int)
            ends, keys, members = heaps.packed()
            yield pd.DataFrame({
                "block": [row.block], "ends": [ends], "keys": [keys], "members": [members], "scanned": [len(member)],
                "deltas": [[{"cluster": int(j), "n": int(n[j]), "total": total[j].tolist()} for j in touched]],
            })


def _finish(batches: Iterator[pd.DataFrame], centroids: np.ndarray, drift: np.ndarray, start: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            heaps, x, _, _, _ = _step(row, centroids, drift, start)
            cluster = heaps.clusters(row.n)
            away = ((x.astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
            yield pd.DataFrame({"id": np.frombuffer(row.ids, np.int64), "no_id": np.frombuffer(row.no_id, bool),
                                "cluster": cluster.astype(np.int32), "distance": away})


def cluster_vectors(df: DataFrame, key: str, vector: str, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256,
                    seed: int = 2, block_rows: int = BLOCK_ROWS) -> Clustering:
    """Lloyd's algorithm in integers, ``rounds`` times assign and move, then assign.

    Components become floor(scale * x); vectors that are null, of another width, or hold null or non-finite components take
    no part, a component beyond 2**27 after scaling is an error.  Centroids start as the k vectors with the smallest sha256
    of ``seed:<id>`` (equal ids: by vector; without id: last); with fewer vectors than k there are as many centroids.  A
    vector joins the nearest centroid, ties go to the smaller number; a centroid becomes the floor of its vectors' mean, an
    empty one stays.  Rows with equal or null ids are vectors each.  An empty table gives no rows and no centroids.

    Vectors are written once in blocks, bucketed by block; every round writes the blocks' heaps with the same buckets, so
    that the join of the two moves nothing.  Blocks have nothing to do with clusters: a cluster of a third of all vectors is
    spread over all blocks.  The driver receives the sums of moved vectors per cluster (k rows) and holds the centroids.
    """
    spark = df.sparkSession
    kept = scaled_vectors(df, key, vector, width, scale)
    order = F.when(~F.col("no_id"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "id long, cluster int, distance long"), centroids, [])

    tables = BucketedTables(spark, "block")
    packed = in_python(kept, lambda b: _blocks(b, block_rows), "block long, n int, ids binary, no_id binary, vectors binary")
    blocks = tables.write(packed.repartition(tables.buckets, "block"), "centroid_blocks")

    drift = np.zeros(len(centroids))
    sums, sizes = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    state, scanned = None, []

    def now() -> DataFrame:
        """Vectors beside their heaps (none before the first round)."""
        vectors = blocks.select("block", "n", "ids", "no_id", "vectors")
        return vectors if state is None else vectors.join(state.select("block", "ends", "keys", "members"), "block")

    for _ in range(rounds):
        args = (centroids, drift, state is None)
        state = tables.write(in_python(now(), lambda b, args=args: _round(b, *args), STATE), "centroid_heaps")
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        delta = state.select(F.explode("deltas").alias("d")).groupBy("d.cluster").agg(
            F.sum("d.n"), *[F.sum(F.col("d.total")[i]) for i in range(width)]).collect()
        for r in delta:
            sizes[r[0]] += r[1]
            sums[r[0]] += np.array(r[2:], np.int64)
        full = sizes > 0
        moved = centroids.copy()
        moved[full] = sums[full] // sizes[full][:, None]
        step = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        rest = np.array([np.delete(step, j).max(initial=0) for j in range(len(step))])
        centroids, drift = moved, drift + step + rest
        if not step.any():  # settled: further rounds change nothing
            break
    args = (centroids, drift, state is None)
    rows = written(in_python(now(), lambda b: _finish(b, *args), "id long, no_id boolean, cluster int, distance long"), "centroid_rows")
    tables.forget()
    return Clustering(rows.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "cluster", "distance"), centroids, scanned)


def with_inertia(done: Clustering) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector; the sums of k clusters are joined back by broadcast."""
    spark = done.rows.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(done.centroids)]
    per = done.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    whole = sum(r["cluster_inertia"] for r in per)
    of = dict(digests)
    facts = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], whole, of[r["cluster"]]) for r in per],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.rows.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
