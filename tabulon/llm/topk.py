"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import per_group, prepare_workers

CANDIDATES_PER_BLOCK = 8192  # rows whose sorted lists one step of a task holds
START_DEPTH = 16


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, v``: components as floor(scale * x) with x as double; without vectors that are null or hold null or non-finite parts."""
    x = F.transform(vector, lambda c: c.cast("double"))
    usable = F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(usable).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v")
    )


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector counts as padded with zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class SortedLists:
    """A block of candidates with one list per dimension, in ascending order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.exact = self.rows.astype(np.float64)
        self.most = float(np.abs(self.exact).max(initial=0))
        self.order = np.argsort(self.rows, axis=0, kind="stable")  # depth x dimension
        self.values = np.take_along_axis(self.rows, self.order, axis=0)

    def top(self, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Merge this block into ``best``, the k best (-score, id) so far.

        Lists are read in step from the end where the query's component weighs most.  No unread
        row can score more than the sum of weight times list value at the present depth, so reading
        stops when the k-th best beats that bound (at equality an unread smaller id could still win).
        """
        n = len(self.ids)
        used = np.flatnonzero(query)
        if not len(used):  # all scores are zero: the smallest ids
            return sorted(best + [(0, int(i)) for i in self.ids[self.ids != query_id][:k]])[:k]
        up = query[used] > 0
        simple = self.most * float(np.abs(query).max()) * len(query) < 2**53
        weight = query.astype(np.float64) if simple else query
        seen = np.zeros(n, dtype=bool)
        read, depth = 0, min(n, START_DEPTH)
        while True:
            depths = np.arange(read, depth)
            places = np.where(up[None, :], n - 1 - depths[:, None], depths[:, None])
            fresh = np.zeros(n, dtype=bool)
            fresh[self.order[places, used[None, :]]] = True
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            at = at[self.ids[at] != query_id]  # before the cut: rows of the query's own id may repeat
            if len(at):
                scores = (self.exact[at] @ weight).astype(np.int64) if simple else self.rows[at] @ query
                keep = np.ones(len(at), dtype=bool)
                if len(best) >= k:
                    keep = scores >= -best[-1][0]
                elif len(at) > k:
                    keep = scores >= np.partition(scores, len(at) - k)[len(at) - k]
                best = sorted(best + [(-int(s), int(i)) for s, i in zip(scores[keep], self.ids[at][keep])])[:k]
            if depth >= n:
                return best
            if len(best) >= k:
                last = np.where(up, n - depth, depth - 1)
                bound = int((query[used] * self.values[last, used]).sum())
                if -best[-1][0] > bound:
                    return best
            read, depth = depth, min(n, depth * 2)


def top_k(queries: DataFrame, candidates: DataFrame, key: str, vector: str, k: int = 10, scale: int = 1024,
          group_rows: int = 65_536, block_queries: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products for each row of ``queries``.

    Candidates are every row of ``candidates`` but those with the query's own id; ties go to the
    smaller id.  Vectors that are null or hold null or non-finite components take no part, of either
    side; shorter vectors are padded with zeros; products beyond 64 bits are outside the domain.  Rows
    with a null id take no part.  Repeated query rows are answered once (two vectors under one query id
    share its k results); repeated candidates are candidates each.  With fewer candidates than k, all are
    returned; an empty side gives no rows.

    Candidates are dealt by a hash into groups of about ``group_rows`` rows and queries into blocks of about
    ``block_queries``; every block meets every group.  A task builds the sorted lists block by block and runs the threshold algorithm
    for each query, carrying the k best from block to block, so that later blocks stop earlier; k rows per
    query and group are merged at the end.
    """
    q = integer_vectors(queries, key, vector, scale).filter("id is not null").distinct()
    c = integer_vectors(candidates, key, vector, scale).filter("id is not null")
    groups = max(1, -(-candidates.count() // group_rows))
    spread = c.sparkSession.sparkContext.defaultParallelism
    groups = max(groups, min(spread, groups * spread))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    blocks = max(1, -(-queries.count() // block_queries))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = c.select(
        F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), each.alias("blk"), F.lit(0).alias("query_side"), "id", "v"
    ).union(q.select(every.alias("grp"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"), F.lit(1).alias("query_side"), "id", "v"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked, offered = group[group.query_side == 1], group[group.query_side == 0]
        if len(asked) and len(offered):
            width = max(max(len(v) for v in group.v), 1)
            ids = offered.id.to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")
            vectors = offered.v.to_numpy()
            best: list[list[tuple[int, int]]] = [[] for _ in range(len(asked))]
            query_rows = _matrix(asked.v.tolist(), width)
            query_ids = asked.id.to_numpy(np.int64)
            for low in range(0, len(order), CANDIDATES_PER_BLOCK):
                part = order[low : low + CANDIDATES_PER_BLOCK]
                lists = SortedLists(ids[part], _matrix(vectors[part].tolist(), width))
                for i in range(len(asked)):
                    best[i] = lists.top(int(query_ids[i]), query_rows[i], k, best[i])
            out = [(int(query_ids[i]), vec, -low) for i, found in enumerate(best) for low, vec in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    prepare_workers(both.sparkSession)
    found = both.groupBy("grp", "blk").applyInPandas(per_group(search), "query_id long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

