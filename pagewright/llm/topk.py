"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are whole numbers. A query's score is a sum over dimensions, so a vector is a document, a
dimension a term, and q * x a contribution. To have no negative ones, a dimension counts from its
least value if q is positive and down from its greatest if q is negative; what that adds to all
scores alike is taken off again. Each task indexes one shard of vectors: for every dimension and
direction the vectors stand in segments of equal quantised impact, highest first.

A query takes the segments of all its dimensions by descending |q| * impact and adds that lower bound to
the accumulators of the segment's vectors. What may still be missing for any vector is bounded: the width of
a level for segments taken, and the impact of the next segment of each dimension for the others. From time
to time the best accumulators are scored exactly. The query stops only when all vectors that could still
reach the k-th best exact score are few enough to be scored exactly, or no segment is left; then all of
those are, so the stop never changes the result. Ties go to the smaller id.

Queries are cut into blocks of ``QUERY_BLOCK`` rows, and every shard meets every block, one at a time: a
task holds one shard index and one block, whatever the numbers of vectors and queries. Shards return at
most k rows per query; these are merged by a top-k per query that also combines before its shuffle.

Vectors that are null, or hold a null or a component that is not finite, take no part; nor do those without
an id. Repeated ids are kept as rows of their own, and a query never meets rows of its own id. Vectors
of another length than the query's do not match it. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut_lineage

K = 5
#: Vectors in a shard, and queries in a block.
SHARD_ROWS, QUERY_BLOCK = 8192, 512
#: Levels of impact in each dimension.
LEVELS = 16


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component) as whole numbers; null for vectors that take no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fit, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class ImpactIndex:
    """Segments of one shard (rows of whole numbers, all of one length)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        # float64 products are exact below 2^53; larger components are multiplied as integers.
        widest = float(np.abs(self.rows).max(initial=0))
        self.small = widest**2 * max(1, rows.shape[1]) < 2**50
        self.exact_rows = self.rows.astype(np.float64) if self.small else self.rows
        self.low, self.high = self.rows.min(0), self.rows.max(0)
        self.width = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        self.postings = {}
        for d in range(rows.shape[1]):
            for up in (True, False):
                impact = self.rows[:, d] - self.low[d] if up else self.high[d] - self.rows[:, d]
                level = impact // self.width[d]
                by = np.argsort(-level, kind="stable")
                cuts = np.flatnonzero(np.diff(level[by])) + 1
                starts = np.concatenate([[0], cuts])
                self.postings[d, up] = [
                    (int(level[by[s]]), part) for s, part in zip(starts, np.split(by, cuts)) if level[by[s]] > 0
                ]

    def scores(self, some: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.small:
            return np.rint(self.exact_rows[some] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[some] @ query

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows whose id is not ``own``."""
        n = len(self.ids)
        mine = np.arange(*np.searchsorted(self.ids, [own, own + 1]))
        terms = [(d, bool(query[d] > 0), int(abs(query[d]))) for d in np.flatnonzero(query)]
        base = int(sum(query[d] * (self.low[d] if up else self.high[d]) for d, up, _ in terms))
        gained = np.zeros(n, np.int64)
        gained[mine] = -(1 << 62)
        work = []  # (gain, term, vectors), highest gain first
        slack = 0  # what the levels of segments already taken may hide
        for t, (d, up, weight) in enumerate(terms):
            slack += weight * int(self.width[d] - 1)
            work += [(weight * level * int(self.width[d]), t, part) for level, part in self.postings[d, up]]
        work.sort(key=lambda x: -x[0])
        missing = [0] * len(terms)
        for gain, t, _ in reversed(work):
            missing[t] = gain  # ends as the highest gain of each term
        following = [0] * len(work)
        last = [0] * len(terms)
        for i in range(len(work) - 1, -1, -1):
            following[i] = last[work[i][1]]
            last[work[i][1]] = work[i][0]
        left = sum(missing)
        few = max(64, 4 * k)
        checks = {len(work) // 2, len(work) * 3 // 4, len(work) * 7 // 8}
        for i, (gain, t, part) in enumerate(work):
            if i in checks and (found := self._final(gained, left + slack, base, query, k, few, n // 50)) is not None:
                return found
            gained[part] += gain
            left += following[i] - gain
        return self._final(gained, slack, base, query, k, few, n)

    def _final(self, gained, may, base, query, k, few, most):
        """The result, if at most ``most`` vectors can be in it."""
        n = len(gained)
        ahead = np.argpartition(-gained, min(few, n - 1))[:few] if n > few else np.arange(n)
        ahead = ahead[gained[ahead] >= 0]
        best = np.sort(self.scores(ahead, query))[::-1]
        least = best[k - 1] if len(best) >= k else -(1 << 61)
        possible = np.flatnonzero((gained >= 0) & (gained + (may + base) >= least))
        if len(possible) > max(most, few):
            return None
        score = self.scores(possible, query)
        by = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible[by]], score[by]


def top_k(vectors: DataFrame, k: int = K, every: int = 50, vector: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score for the queries: rows of ``vectors`` (vec_id, vector: whole numbers)
    whose id is divisible by ``every``, against all rows."""
    spark = vectors.sparkSession
    rows = cut_lineage(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("v")).where(
            "vec_id IS NOT NULL AND v IS NOT NULL"
        )
    )
    shards = max(1, -(-rows.count() // shard_rows))
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("block"), "vec_id", "v")
    # The stated queries against all rows: each block of queries goes to each shard.
    to_all = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        "vec_id",
        "v",
    )
    # More partitions than shards, so that few shards share one.
    cells = max(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.union(to_all).repartition(cells, "shard").sortWithinPartitions("shard", "block")

    def search(batches):
        at, index, parts = None, {}, []
        for b in batches:
            shard, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | ((block[1:] < 0) != (block[:-1] < 0))) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                part = b.slice(lo, hi - lo)
                if shard[lo] != at:
                    at, index, parts = shard[lo], {}, []
                if block[lo] < 0:
                    parts.append(part)
                    continue
                if parts:
                    index, parts = _indexes(parts), []
                yield _answers(part, index, k)

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(part: pa.RecordBatch):
    """(length, ids, matrix) for the vectors of each length in a batch."""
    column = part.column(3)
    sizes = np.diff(column.offsets.to_numpy())
    ids, flat = part.column(2).to_numpy(), column.flatten().to_numpy()
    owner = np.repeat(sizes, sizes)
    for size in np.unique(sizes):
        yield int(size), ids[sizes == size], flat[owner == size].reshape(-1, size) if size else np.zeros((int((sizes == 0).sum()), 0), np.int64)


def _indexes(parts: list[pa.RecordBatch]) -> dict[int, ImpactIndex]:
    held: dict[int, list] = {}
    for part in parts:
        for size, ids, rows in _by_length(part):
            held.setdefault(size, []).append((ids, rows))
    return {size: ImpactIndex(*map(np.concatenate, zip(*found))) for size, found in held.items()}


def _answers(part: pa.RecordBatch, index: dict[int, ImpactIndex], k: int) -> pa.RecordBatch:
    queries, ids, scores = [], [], []
    for size, asked, rows in _by_length(part):
        if size in index:
            for own, query in zip(asked.tolist(), rows):
                found, score = index[size].top(own, query, k)
                queries += [own] * len(found)
                ids += found.tolist()
                scores += score.tolist()
    columns = [pa.array(x, pa.int64()) for x in (queries, ids, scores)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])
