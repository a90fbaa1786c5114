"""N-gram Jaccard join with a count-vector R-tree.

Documents link when 100 * intersection >= 90 * union of their sets of 3-word shingles. Every document
gets the least doc id it reaches by links.

1. Sets. Each text becomes a set of 64-bit shingle hashes with a 64-bit name. Equal sets have equal
   names, so copies are one node from here on.
2. Buckets. Linked sets of sizes a <= b differ in at most D = (a + b) / 19 shingles. For a band of sizes
   with that bound D the hash range is cut into D + 3 groups. At least three groups of a linked pair
   hold the same shingles, so at least one of those is not empty, unless both sets have more than
   two empty groups; such sets share one further bucket. A node joins one bucket for each
   non-empty group (band, group, hash of the group's shingles), for its own band and for the next if it
   may link into it. So every link lies inside a bucket, and a frequent shingle alone does not fill
   one. Buckets of one node are dropped by an aggregate that combines before it shuffles.
3. Leaders. Each node is tested with the least node of each of its buckets; links found make first
   components. In large groups of near copies this settles most nodes at linear cost.
4. R-tree. The other way to count: shingles hashed into 128 groups make a point of counts. Inside
   each bucket points are packed into an R-tree; a node of the tree holds the largest count of each
   group. The sum of coordinate minima bounds the overlap of a point with anything below. Pairs whose
   bound reaches the threshold survive; pairs in one component, or too different in size, do not matter.
   Buckets over ``PAGE`` nodes are cut into pages, and pairs of pages are searched apart.
5. Forests. Of the surviving pairs of a bucket only a spanning forest leaves it: a pair counts while its ends
   are not yet joined by pairs that left, and what is joined is searched no further. So a bucket of n nodes gives
   at most n - 1 pairs, however many of them are near copies of each other.
6. Verification. The pairs that left are verified on the full sets and the links found make larger components.
   Where a pair did not link, its bucket is searched again without it, for eight times as many forests as before,
   until each bucket has a round in which all pairs that left it link. Then whatever is not joined was tested.

No pair is dropped untested, no set is cut, no bucket has a limit. Shingles and sets are told apart by
64-bit hashes. Null and blank texts have empty sets and link with nothing. Rows with a null doc id take
part, but do not name a component; without a named member a component is null. Repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import byte_texts, portions
from pagewright.llm.components import components
from pagewright.llm.ids import release
from pagewright.llm.shingles import mix, set_id, shingle_set
from pagewright.session import work_dir

SHINGLE = 3
#: Links need 9 * union <= 10 * intersection, which means 19 * intersection >= 9 * (a + b).
#: Groups beyond D + 1, so that a pair may share as many empty ones.
SPARE = 2
#: Dimensions of a point.
DIMENSIONS = 128
#: Nodes of a bucket that one tree holds.
PAGE = 2048
FANOUT = 16
#: Points that descend the trees at a time: with pages this bounds the pairs a worker holds.
QUERIES = 128
#: Names of texts to fetch that are broadcast; more are joined by a shuffle.
BROADCAST_NAMES = 1_000_000

_STARTS = [10]
while _STARTS[-1] < 1 << 40:
    _STARTS.append(_STARTS[-1] * 7 // 5)
_STARTS = np.array(_STARTS)


def bands_of(n: int) -> list[int]:
    """Size bands a set of n shingles joins; sets under 9 link with equal sets only."""
    own = int(np.searchsorted(_STARTS, n, side="right")) - 1
    after = own + 1
    return [b for b in (own, after) if b >= 0 and (b == own or 10 * n >= 9 * _STARTS[b])]


def _edges(groups: int) -> np.ndarray:
    return np.array([-(-(g << 64) // groups) for g in range(1, groups)], np.uint64)


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """The buckets of a set, as 64-bit numbers."""
    found = []
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    for band in bands_of(len(hashes)):
        groups = 2 * int(_STARTS[band + 1] - 1) // 19 + 1 + SPARE
        if groups not in _EDGES:
            _EDGES[groups] = _edges(groups)
        cuts = np.concatenate([[0], np.searchsorted(hashes, _EDGES[groups]), [len(hashes)]])
        some = np.flatnonzero(np.diff(cuts))
        inside = sums[cuts[some + 1]] - sums[cuts[some]]
        found.append(mix(inside + mix((some + (band << 40) + 1).astype(np.uint64))))
        if groups - len(some) > SPARE:
            found.append(mix(np.array([(band << 40) + (1 << 39)], np.uint64)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


_EDGES: dict[int, np.ndarray] = {}


def counts_of(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS)


def signatures(documents: DataFrame, size: int = SHINGLE, row: str | None = None) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, node (the set's name) and its bucket keys.

    ``row`` names a column of row keys, which comes along as ``row_key``.
    """

    def sign(batches):
        release()
        for b in portions(batches, 500):
            n, nodes, keys = [], [], []
            for text in byte_texts(b.column(2)):
                hashes = shingle_set(text, size)
                n.append(len(hashes))
                nodes.append(set_id(hashes))
                keys.append(bucket_keys(hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *b.columns[3:]],
                ["doc_id", "text_hash", "n_shingles", "node", "keys", "row_key"][: 5 + bool(row)],
            )

    more = [F.col(row)] if row else []
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text", *more).mapInArrow(
        sign, "doc_id long, text_hash long, n_shingles long, node long, keys array<long>" + ", row_key long" * bool(row)
    )


def _sets(documents: DataFrame, signed: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Full sets and points of the given nodes, one row per node."""
    # Combined before the shuffle, so that a set with very many copies is one row.
    one_text = signed.groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    wanted = one_text.join(nodes, "node", "left_semi").select("text_hash").distinct()
    if nodes.count() <= BROADCAST_NAMES:  # the same rows by either way
        wanted = F.broadcast(wanted)
    texts = documents.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash", "left_semi").select("text")

    def make(batches):
        release()
        for b in portions(batches, 500):
            found = [shingle_set(t, size) for t in byte_texts(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([set_id(h) for h in found], pa.int64()),
                    pa.array([len(h) for h in found], pa.int64()),
                    pa.array([h.tobytes() for h in found], pa.binary()),
                    pa.array([counts_of(h).astype("<u4" if len(h) > 65535 else "<u2").tobytes() for h in found], pa.binary()),
                ],
                ["node", "n", "hashes", "point"],
            )

    return texts.mapInArrow(make, "node long, n long, hashes binary, point binary").dropDuplicates(["node"])


def _points(column: pa.Array) -> np.ndarray:
    raw = [x.as_buffer() for x in column]
    return np.array([np.frombuffer(x, "<u2" if x.size == 2 * DIMENSIONS else "<u4") for x in raw], np.int32).reshape(-1, DIMENSIONS)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection of linked sets of these sizes."""
    return -(-9 * (a + b) // 19)


class RTrees:
    """R-trees of many buckets, searched together.

    Rows come sorted by bucket. Each level holds boxes of up to ``FANOUT`` neighbours of one bucket: the
    largest count of each group, the least and largest size, and the least and largest component.
    """

    def __init__(self, bucket, side, n, comp, points):
        order = np.lexsort((points[:, 1], points[:, 0], n, bucket))
        self.order = order
        self.bucket, self.side, self.n, self.comp, self.points = bucket[order], side[order], n[order], comp[order], points[order]
        owner, last = self.bucket, np.arange(len(order))
        low, high, least, most, box = self.n, self.n, self.comp, self.comp, self.points
        self.levels = []
        while True:
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(owner)))
            inside = np.arange(len(owner)) - np.repeat(starts, sizes)
            first = np.flatnonzero(inside % FANOUT == 0)
            ends = np.append(first[1:], len(owner))
            owner, last = owner[first], last[ends - 1]
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            box = np.maximum.reduceat(box, first, axis=0)
            self.levels.append((first, ends, last, low, high, least, most, box))
            if len(first) == len(starts):
                break

    def join(self, comp: np.ndarray) -> None:
        """Go on with other components of the rows."""
        self.comp = least = most = comp[self.order]
        for k, (first, ends, last, low, high, _, _, box) in enumerate(self.levels):
            least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            self.levels[k] = (first, ends, last, low, high, least, most, box)

    def pairs(self, cross: np.ndarray):
        """Surviving pairs (row, row, bound). ``cross`` per row: only pairs of different sides count.

        Between two yields the caller may :meth:`join` components."""
        roots = np.cumsum(np.concatenate([[False], self.bucket[1:] != self.bucket[:-1]]))
        for at in range(0, len(self.n), QUERIES):
            q = np.arange(at, min(at + QUERIES, len(self.n)))
            box = roots[q]
            for depth in range(len(self.levels) - 1, -1, -1):
                first, ends, last, low, high, least, most, boxes = self.levels[depth]
                n = self.n[q]
                fit = (last[box] > q) & (10 * np.minimum(n, high[box]) >= 9 * np.maximum(n, low[box]))
                fit &= (least[box] != most[box]) | (least[box] != self.comp[q])
                q, box, n = q[fit], box[fit], n[fit]
                least_size = np.maximum(low[box], -(-9 * n // 10))
                fit = _overlap(self.points, q, boxes, box) >= needed(n, least_size)
                q, box = q[fit], box[fit]
                many = ends[box] - first[box]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                q, box = np.repeat(q, many), np.repeat(first[box], many) + step
            n, m = self.n[q], self.n[box]
            fit = (box > q) & (self.comp[q] != self.comp[box]) & (10 * np.minimum(n, m) >= 9 * np.maximum(n, m))
            fit &= ~cross[self.order[q]] | (self.side[q] != self.side[box])
            q, box = q[fit], box[fit]
            bound = _overlap(self.points, q, self.points, box)
            fit = bound >= needed(self.n[q], self.n[box])
            q, box, bound = q[fit], box[fit], bound[fit]
            yield self.order[q], self.order[box], bound / (self.n[q] + self.n[box] - bound)


def _overlap(a: np.ndarray, i: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of rows ``i`` of a and ``k`` of b."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 8192):
        s = slice(at, at + 8192)
        out[s] = np.minimum(a[i[s]], b[k[s]]).sum(1)
    return out


class Forests:
    """Spanning forests over the components of each bucket, made of the pairs that are met."""

    def __init__(self, bucket: np.ndarray, comp: np.ndarray, share: int):
        self.tree = np.unique(np.stack([bucket, comp], 1), axis=0, return_inverse=True)[1].reshape(-1)
        n = int(self.tree.max()) + 1
        self.above = [list(range(n)) for _ in range(min(share, n))]

    @staticmethod
    def _root(above: list[int], x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def take(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray, refused) -> list[int]:
        """Which of the pairs of rows a forest has a use for, the greatest bounds first."""
        chosen = []
        left, right = self.tree[a].tolist(), self.tree[b].tolist()
        for k in np.argsort(-bound, kind="stable").tolist():
            if refused(k):
                continue
            for above in self.above:
                x, y = self._root(above, left[k]), self._root(above, right[k])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    chosen.append(k)
                    break
        return chosen

    def joined(self) -> np.ndarray:
        """Per row, what it is joined with in all forests."""
        above = self.above[-1]
        return np.array([self._root(above, x) for x in range(len(above))], np.int64)[self.tree]


def _bucket_pairs(members: DataFrame, sets: DataFrame, share: int = 1, refused: DataFrame | None = None) -> DataFrame:
    """Pairs (key, a, b) of nodes of different components that survive the R-trees of their buckets, as many as
    ``share`` forests of each bucket hold, without those in ``refused`` (a, b).

    ``members``: key, node, comp, for the buckets to be searched.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    points = sets.select("node", "n", "point")
    if refused is not None:
        partners = refused.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("refused"))
        points = points.join(partners, "node", "left")
    else:
        points = points.withColumn("refused", F.lit(None).cast("array<long>"))
    paged = (
        members.join(sizes, "key")
        .withColumn("_pages", F.ceil(F.col("_n") / PAGE).cast("int"))
        .withColumn("_page", F.pmod(F.xxhash64("node"), F.col("_pages")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1)))
        .select("key", F.least("_page", "_other").alias("i"), F.greatest("_page", "_other").alias("k"), "_page", "node", "comp")
        .join(points, "node")
    )
    cells = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = paged.repartition(cells, "key", "i", "k").sortWithinPartitions("key", "i", "k")

    def search(batches):
        release()
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in portions(batches, 4096):
            held.append(b)
            rows += b.num_rows
            if rows < 4096:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            group = _groups(whole)
            cut = int(np.searchsorted(group, group[-1]))  # the last cell may go on
            if cut:
                yield from _searched(whole.slice(0, cut), share)
            held = whole.slice(cut).to_batches()
            rows = whole.num_rows - cut
        if rows:
            yield from _searched(pa.Table.from_batches(held).combine_chunks(), share)

    return dealt.mapInArrow(search, "key long, a long, b long")


def _groups(rows: pa.Table) -> np.ndarray:
    """Cell numbers of rows sorted by key, i and k."""
    new = np.zeros(rows.num_rows, bool)
    for name in ("key", "i", "k"):
        x = rows[name].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _searched(rows: pa.Table, share: int):
    rows = rows.combine_chunks()
    node, key, cell, comp = rows["node"].to_numpy(), rows["key"].to_numpy(), _groups(rows), rows["comp"].to_numpy()
    gone = {(n, m) for n, many in zip(node.tolist(), rows["refused"].to_pylist()) for m in many or ()}
    trees = RTrees(cell, rows["_page"].to_numpy(), rows["n"].to_numpy(), comp, _points(rows["point"].combine_chunks()))
    forests = Forests(cell, comp, share)
    for q, r, bound in trees.pairs(rows["i"].to_numpy() != rows["k"].to_numpy()):
        if not len(q):
            continue
        a, b = np.minimum(node[q], node[r]), np.maximum(node[q], node[r])
        chosen = forests.take(q, r, bound, lambda k, a=a, b=b: (int(a[k]), int(b[k])) in gone if gone else False)
        if chosen:
            trees.join(forests.joined())
            yield pa.RecordBatch.from_arrays([pa.array(key[q[chosen]]), pa.array(a[chosen]), pa.array(b[chosen])], ["key", "a", "b"])


def _with_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(column).alias("xa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(column).alias("xb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb")


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose summed minima reach the threshold."""

    def bound(batches):
        for b in portions(batches, 4096):
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            overlap = np.minimum(_points(b.column(4)), _points(b.column(5))).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(overlap >= needed(na, nb)))

    return _with_sets(pairs, sets, "point").where("10 * least(na, nb) >= 9 * greatest(na, nb)").mapInArrow(bound, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by their full sets."""

    def verify(batches):
        for b in portions(batches, 1000):
            keep = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= 90 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets, "hashes").mapInArrow(verify, "a long, b long")


def node_components(documents: DataFrame, signed: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``node`` and ``label`` for every node that links with another one."""
    spark = documents.sparkSession
    folder = work_dir(spark, "jaccard")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = signed.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("_other")).where("lead < _other").select("key", "lead")
    members = kept(rows.join(shared, "key").select("key", "node", "lead").distinct(), "members")
    nodes = members.select("node").distinct()
    sets = kept(_sets(documents, signed, nodes, size), "sets")

    first = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = kept(_verified(_bounded(first, sets), sets), "links-0")
    labels = components(links)

    def label_of(df: DataFrame, node: str, name: str) -> DataFrame:
        named = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        return df.join(named, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", node)).drop("_node", "_label")

    todo, refused, share, turn = members.select("key").distinct(), None, 1, 0
    while True:
        turn += 1
        labelled = label_of(members.select("key", "node").join(todo, "key", "left_semi"), "node", "comp")
        mixed = labelled.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a < _b").select("key")
        pairs = kept(_bucket_pairs(labelled.join(mixed, "key", "left_semi"), sets, share, refused), f"pairs-{turn}")
        if pairs.isEmpty():
            return labels
        good = kept(_verified(pairs.select("a", "b").distinct(), sets), f"links-{turn}")
        links = links.union(good)
        labels = components(links)
        bad = kept(pairs.join(good, ["a", "b"], "left_anti"), f"refused-{turn}")
        todo = bad.select("key").distinct()
        some = bad.select("a", "b").distinct()
        refused = some if refused is None else refused.union(some)
        share *= 8


def jaccard_components(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles and component_id."""
    spark = documents.sparkSession
    folder = work_dir(spark, "jaccard-signatures")
    signatures(documents, size).write.parquet(f"{folder}/signed")
    signed = spark.read.parquet(f"{folder}/signed")
    labels = node_components(documents, signed, size)
    # A class is all that has one label; empty sets stay alone.
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("least"))
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    # Written, so that the last join may split the documents of a set with very many copies.
    classes.join(least, "label").select("node", "component_id").write.parquet(f"{folder}/components")
    of_node = spark.read.parquet(f"{folder}/components")
    return (
        signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
        .join(of_node, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one_each(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each component, all columns as they were: that of the least doc id, nulls last.

    Rows are told apart by a key of their own, so rows may share a doc id or have none: rows that repeat a
    doc id with other text count as the documents they are. Of rows equal in doc id the one with the least
    text hash stays, of rows equal in text too any one. Null and blank texts link with nothing and stay.
    """
    spark = documents.sparkSession
    folder = work_dir(spark, "jaccard-rows")
    row = "_row_key"
    while row in documents.columns:
        row += "_"
    # Written, so that every later read finds the same key on the same row.
    documents.withColumn(row, F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    signatures(rows, size, row).write.parquet(f"{folder}/signed")
    signed = spark.read.parquet(f"{folder}/signed")
    labels = node_components(rows, signed, size)
    some = signed.where("n_shingles > 0")
    # Combined before the shuffle, first by set and then by component.
    best = some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_key")).alias("best"))
    winners = (
        best.join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("label"))
        .agg(F.min("best").alias("best"))
        .select("best.row_key")
    )
    gone = some.select("row_key").join(winners, "row_key", "left_anti").select(F.col("row_key").alias("_gone"))
    return rows.join(gone, rows[row] == F.col("_gone"), "left_anti").drop(row)
