"""Line dedup over a levelled store of sorted runs, in DataFrame functions only.

A line's key is the line without white space at both ends, A to Z lower-cased. Keys that stand in at least
``min_docs`` documents are repeated; all their lines go, in every document.

:class:`LineRuns` keeps for every key, as a 128-bit hash, the number of documents it was met in. Documents
come in batches. A batch is counted, merge-anti-joined with the runs that are there (keys that some run
already knows as repeated need no more counting) and what is left becomes a run of its own, on the first
level. When a level holds ``fanout`` runs they are merged into one run of the next level, so a
key stands in at most ``fanout`` runs of each of logarithmically many levels. Runs are tables bucketed and sorted
by the hash, so joining and merging them shuffles the new batch only. A list of the runs is written after each
change, with the batches they hold: a job that is repeated after a failure skips those it has
added, and :meth:`LineRuns.open` goes on with a store of an earlier session.

A hot line costs no more than any other: documents count it once, counts are combined before they are
shuffled, and when lines look their count up, repeated keys are copied ``SALTS`` times and met by the
lines of each key in as many parts. Lines of a document meet again in one array, which its text
bounds.

Null and empty texts are one empty line. Empty keys are never repeated. A document is a row: rows equal in
all columns, or in the id, count one each. Extra columns pass through; ``n_lines`` and ``n_dropped`` are set, replacing
columns of those names. Without a text column there is nothing to do: the caller names it. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagewright.session import cut_lineage, work_dir

MIN_DOCS = 10
#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Batches that a whole table is dealt into.
BATCHES = 4
#: Parts that the lines of a repeated key are spread over when they look it up.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "\t\n\u000b\f\r "
_KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _LOWER)


def _hashes(text: Column) -> Column:
    """The hash pair of every line's key, in order; null for empty keys, which never repeat.

    Two steps, so that each key is made once: Spark does not share parts of a lambda."""
    keys = F.transform(lines_of(text), line_key)
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n) under ``folder``, where n is the documents counted."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs must be 1 or more and fanout 2 or more")
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> LineRuns:
        """The store that ``folder`` holds, as its last whole list of runs says; a new one where there is none."""
        store = cls(spark, folder, min_docs, fanout)
        try:
            lists = spark.read.parquet(f"{folder}/lists")
        except AnalysisException:
            return store
        last = lists.where(F.col("version") == lists.agg(F.max("version")).first()[0]).first()
        store.version, store.batches, store.buckets = last.version, list(last.batches), last.buckets
        store.levels = [list(level) for level in last.levels]
        for name in sum(store.levels, []):
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {store.buckets} BUCKETS LOCATION '{folder}/{name}'"
            )
        return store

    def add(self, batch: str, keys: DataFrame) -> None:
        """Count a batch of keys (h1, h2), one row for each document and key; a batch is added once."""
        if batch in self.batches:
            return
        counts = keys.groupBy(_KEY).agg(F.count(F.lit(1)).alias("n"))
        for name in sum(self.levels, []):
            counts = counts.join(self.spark.table(name).where(F.col("n") >= self.min_docs), _KEY, "left_anti")
        levels = [list(level) for level in self.levels] or [[]]
        levels[0].append(self._write(counts))
        k = 0
        while len(levels[k]) >= self.fanout:
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(self._write(self._merged(levels[k])))
            levels[k] = []
            k += 1
        self._publish(levels, [*self.batches, batch])

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key no run knows as repeated, all columns kept."""
        for name in sum(self.levels, []):
            keys = keys.join(self.spark.table(name).where(F.col("n") >= self.min_docs), _KEY, "left_anti")
        return keys

    def repeated(self) -> DataFrame:
        """Keys (h1, h2) met in ``min_docs`` documents or more."""
        names = sum(self.levels, [])
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(names).where(F.col("n") >= self.min_docs).select(_KEY)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged two by two, each pair by one merge join of its sorted buckets."""
        runs = self.spark.table(names[0])
        for k, name in enumerate(names[1:], 2):
            other = self.spark.table(name).withColumnRenamed("n", "m")
            total = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            runs = runs.join(other, _KEY, "full_outer").select(*_KEY, total.alias("n"))
            if k < len(names):
                runs = self.spark.table(self._write(runs))
        return runs

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        written = counts.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.folder}/{name}")
        written.saveAsTable(name, format="parquet")
        return name

    def _publish(self, levels: list[list[str]], batches: list[str]) -> None:
        """Write the new list of runs and go over to it. Tables only the older list names are of no more use."""
        schema = "version long, buckets int, levels array<array<string>>, batches array<string>"
        row = (self.version + 1, self.buckets, levels, batches)
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/lists")
        for name in set(sum(self.levels, [])) - set(sum(levels, [])):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.version, self.levels, self.batches = self.version + 1, levels, batches


def _told_apart(docs: DataFrame, text: str) -> DataFrame:
    """The whole rows as ``row`` with the text and a hash pair of all columns; only equal rows share one."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]), {"ignoreNullFields": "false"})
    value = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        value.alias("text"),
        F.xxhash64(whole, value).alias("d1"),
        F.xxhash64(F.lit(1), value, whole).alias("d2"),
    )


def keys_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (h1, h2, d1, d2) for every document and key in it; d1 and d2 tell documents apart."""
    keys = F.array_distinct(_hashes(F.col("text")))
    each = _told_apart(docs, text).select("d1", "d2", F.explode(keys).alias("key"))
    return each.where("key IS NOT NULL").select("key.h1", "key.h2", "d1", "d2")


def count_lines(docs: DataFrame, runs: LineRuns, text: str = "text", batches: int = BATCHES) -> LineRuns:
    """Add ``docs`` to ``runs`` in batches that a hash of the row deals out; their keys are written once."""
    dealt = f"{runs.folder}/keys-{uuid.uuid4().hex}"
    part = F.pmod(F.col("d1"), F.lit(batches)).alias("batch")
    keys_of(docs, text).select(*_KEY, part).write.partitionBy("batch").parquet(dealt)
    schema = "h1 long, h2 long, batch long"
    for k in range(batches):
        runs.add(f"{dealt}/{k}", runs.spark.read.schema(schema).parquet(dealt).where(F.col("batch") == k).select(_KEY))
    return runs


def drop_repeated(docs: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the lines whose keys are in ``repeated``: the other lines stay, joined by a line feed;
    n_lines (before dropping) and n_dropped are added."""
    rows = _told_apart(docs, text)
    lines = rows.select("d1", "d2", F.posexplode(_hashes(F.col("text"))).alias("pos", "key"))
    salt = F.pmod(F.xxhash64("d1", "pos"), F.lit(SALTS))
    met = (
        lines.where("key IS NOT NULL")
        .select("d1", "d2", "pos", "key.h1", "key.h2", salt.alias("salt"))
        .join(repeated.select(*_KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), [*_KEY, "salt"])
    )
    # Equal rows give equal places, which the set takes once, on both sides of the shuffle.
    gone = met.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    found = rows.join(gone, ["d1", "d2"], "left")
    split = lines_of(F.col("text"))
    n_dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_without(split, F.col("gone")), "\n"))
    columns = [F.col(f"row.`{c}`") if c != text else kept.alias(text) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return found.select(*columns, F.size(split).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def _without(lines: Column, gone: Column) -> Column:
    """Lines at other places than ``gone`` (ascending): the stretches between two such places, in a row.
    Linear in the lines, as each stretch is one slice."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    stretch = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice(lines, s.a + 1, s.b - s.a))
    return F.flatten(stretch)


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` without all lines repeated in ``min_docs`` of them, counted in a store of its own."""
    spark = docs.sparkSession
    runs = count_lines(docs, LineRuns(spark, work_dir(spark, "line-runs"), min_docs), text, batches)
    return drop_repeated(docs, cut_lineage(runs.repeated()), text)
