"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A repaired conversation is empty, or an optional system turn followed by user and assistant turns in pairs.
Rows are kept (cost 0), given the role they should have (1), deleted (2; blank and repeated rows must be) or
follow an inserted empty turn (5); a truncated row that stays costs 5 more. Of the cheapest edits
those with the least audit are taken, the initials K, R, D and I in order.

**Weights.** Every path through (row, roles so far) is one whole number: its cost in the high digits, and below
them its audit letters as digits of fixed width from the left, with zeros at the end. The less of two numbers is
thus the cheaper path, or of equally cheap ones that with the lesser audit (a prefix ends in zeros, and no letter is
zero), so an ordinary minimum of integers decides everything (:func:`weigh`).

**Long conversations.** Rows are put in order over the whole table at once, and cut into blocks of
``BLOCK_ROWS`` rows or fewer of one conversation. A block is weighed from each state it may begin in to
each it may end in; blocks then meet in pairs, like matrices. Two paths over the same rows of equal cost never
have audits of which one begins with the other, as letters fix the cost, so joining the least parts gives the
least whole. Only the letters, one byte for each row, meet in one place; rows and texts stay in their
blocks. The digest of a repaired conversation needs its text from start to end (SHA-256 has no other way): one task
streams it in batches, in order, without holding it.

**Order.** By turn (null first), role, then md5 of the text; equal rows are adjacent. Null conversation ids are one
conversation, null roles and texts one space. Rows equal in all four are counted and travel as one.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.keyed import attach_by_key
from pagewright.session import work_dir

BLOCK_ROWS = 512
#: Faults of a row.
NONE, BLANK, REPEATED, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
_CODE = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = " DIKR"
_BITS = 3
_ORDER = ["c", "known", "at", "role", "digest"]
_WHITE = " \\t\\n\\x0B\\f\\r"


# ---- weighing -------------------------------------------------------------------------------------------


class Paths:
    """Least numbers of the paths that end in each state, with the letters each has; ``digits`` is the room for letters."""

    def __init__(self, digits: int, state: int):
        self.room = _BITS * digits
        self.best: list[tuple[int, int] | None] = [None] * STATES
        self.best[state] = (0, 0)

    def _with(self, path: tuple[int, int], cost: int, letter: str, times: int = 1) -> tuple[int, int]:
        weight, n = path
        digits = ((1 << _BITS * times) - 1) // 7 * _CODE[letter]
        return weight + (cost << self.room) + (digits << (self.room - _BITS * (n + times))), n + times

    def insert(self) -> None:
        """Inserted turns before what comes next. More than two in a row never pay."""
        best = self.best
        for source, to in ((EMPTY, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            if best[source]:
                best[to] = _least(best[to], self._with(best[source], INSERT, "I"))

    def row(self, initial: str, fault: int, copies: int) -> None:
        """A row, and ``copies`` - 1 rows equal to it."""
        self.insert()
        new: list[tuple[int, int] | None] = [None] * STATES
        for state, path in enumerate(self.best):
            if not path:
                continue
            new[state] = _least(new[state], self._with(path, DELETE * copies, "D", copies))
            if fault in (BLANK, REPEATED):
                continue
            extra = CUT if fault == TRUNCATED else 0
            to = ASSISTANT if state == USER else USER
            edits = [(to, REROLE, "R")]
            if initial == ("a" if state == USER else "u"):
                edits.append((to, KEEP, "K"))
            if initial == "s" and state == EMPTY:
                edits.append((SYSTEM, KEEP, "K"))
            for end, cost, letter in edits:
                done = self._with(path, cost + extra, letter)
                if copies > 1:
                    done = self._with(done, DELETE * (copies - 1), "D", copies - 1)
                new[end] = _least(new[end], done)
        self.best = new

    def ends(self) -> list[tuple[int, str] | None]:
        """Cost and letters of the least path to each state."""
        out: list[tuple[int, str] | None] = []
        for path in self.best:
            if path:
                weight, n = path
                low = (weight & ((1 << self.room) - 1)) >> (self.room - _BITS * n)
                path = (weight >> self.room, oct(low)[2:].translate(_NAMES) if n else "")
            out.append(path)
        return out


_NAMES = {ord(str(code)): letter for letter, code in _CODE.items()}


def _least(a: tuple[int, int] | None, b: tuple[int, int]) -> tuple[int, int]:
    return b if a is None or b < a else a


def weigh(rows: list[tuple[str, int, int]], first: bool) -> list[list[tuple[int, str] | None]]:
    """From each state, the least (cost, audit) to each state over rows (initial, fault, copies).

    Rows that begin a conversation (``first``) are weighed from the empty state only."""
    digits = sum(copies + 2 for _, _, copies in rows) + 2
    table: list[list[tuple[int, str] | None]] = []
    for state in range(STATES):
        if first and state != EMPTY:
            table.append([None] * STATES)
            continue
        paths = Paths(digits, state)
        for row in rows:
            paths.row(*row)
        table.append(paths.ends())
    return table


def _product(a, b):
    """Two tables in a row; (cost, audit) pairs compare like the numbers they stand for."""
    out = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for j in range(STATES):
            found = [
                (a[i][k][0] + b[k][j][0], a[i][k][1] + b[k][j][1]) for k in range(STATES) if a[i][k] and b[k][j]
            ]
            out[i][j] = min(found) if found else None
    return out


def decide(tables: list) -> tuple[int, str]:
    """Cost and audit of a conversation from the tables of its blocks, in order."""
    while len(tables) > 1:
        tables = [_product(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    ends = [(cost, audit) for cost, audit in filter(None, (tables[0][EMPTY][s] for s in (EMPTY, ASSISTANT)))]
    for state, missing in ((USER, 1), (SYSTEM, 2)):
        if tables[0][EMPTY][state]:
            cost, audit = tables[0][EMPTY][state]
            ends.append((cost + INSERT * missing, audit + "I" * missing))
    return min(ends)


# ---- rows -----------------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults that a hash of ``conv_id:turn`` plants in a quarter of them; nulls become a space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _named(conv_id: Column) -> Column:
    """A conversation as text, also a null one."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def _rows(turns: DataFrame) -> DataFrame:
    """Distinct rows in keys that are never null, with how often each is there."""
    space = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), space)
    rows = turns.select(
        _named(F.col("conv_id")).alias("c"),
        F.col("turn").isNotNull().cast("int").alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.md5(text.cast("binary")).alias("digest"),
        text.alias("text"),
    )
    return rows.groupBy(_ORDER).agg(F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))


def _faults(rows: DataFrame) -> DataFrame:
    """Narrow rows with the fault of the first copy."""
    last = F.regexp_extract("text", f"([^{_WHITE}])[{_WHITE}]*\\z", 1)
    narrow = rows.select(
        *_ORDER, "copies", (F.translate("text", " \t\n\u000b\f\r", "") == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open")
    )
    place = F.struct("known", "at")
    said = narrow.groupBy("c", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    met = attach_by_key(narrow, said, ["c", "role", "digest"], "times", ["first"], ["c", "known", "at", "role", "digest"])
    later = (F.col("first.known") < F.col("known")) | (F.col("first.at") < F.col("at"))
    fault = F.when(F.col("blank"), BLANK).when(later, REPEATED).when(F.col("open"), TRUNCATED).otherwise(NONE)
    return met.select(*_ORDER, "copies", fault.alias("fault"))


_BLOCK = (
    "c string, part int, block long, first boolean, rows array<struct<known: int, at: bigint, role: string, digest: string, "
    "copies: bigint, fault: int>>"
)


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows of each conversation, in order, in blocks; (part, block) orders those of a conversation."""
    fields = ["known", "at", "role", "digest", "copies", "fault"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, out = TaskContext.get().partitionId(), 0, []
        held: list[dict] = []
        size, name, first = 0, None, False

        for b in batches:
            for row in b.to_pylist():
                c = row.pop("c")
                if held and (c != name or len(held) >= block_rows or size >= block_rows):
                    out.append({"c": name, "part": part, "block": n, "first": first, "rows": held})
                    n, held, size, first = n + 1, [], 0, False
                # What a partition begins with may go on from the one before.
                first, name = first or (name is not None and c != name), c
                held.append(row)
                size += row["copies"]
            if len(out) >= 200:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held:
            out.append({"c": name, "part": part, "block": n, "first": first, "rows": held})
        yield pa.RecordBatch.from_pylist(out, schema)

    row = pa.struct([("known", pa.int32()), ("at", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("copies", pa.int64()), ("fault", pa.int32())])
    schema = pa.schema([("c", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("first", pa.bool_()), ("rows", pa.list_(row))])
    return rows.select("c", *fields).orderBy(*_ORDER).mapInArrow(cut, _BLOCK)


_SUMMARY = (
    "c string, part int, block long, n long, blank long, repeated long, truncated long, illegal long, head string, tail string, "
    "paths array<struct<cost: bigint, audit: string>>"
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the other blocks of a conversation need to know of one."""
    path = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
    schema = pa.schema(
        [("c", pa.string()), ("part", pa.int32()), ("block", pa.int64())]
        + [(name, pa.int64()) for name in ("n", "blank", "repeated", "truncated", "illegal")]
        + [("head", pa.string()), ("tail", pa.string()), ("paths", pa.list_(path))]
    )
    for b in batches:
        out = []
        for x in b.to_pylist():
            count = [0, 0, 0, 0]
            illegal, before = 0, None
            rows = []
            for r in x["rows"]:
                copies, fault, initial = r["copies"], r["fault"], r["role"][:1]
                count[fault] += 1
                count[BLANK if fault == BLANK else REPEATED] += copies - 1
                illegal += (copies - 1) + (before is not None and before + initial not in ("su", "ua", "au"))
                before = initial
                rows.append((initial, fault, copies))
            table = weigh(rows, x["first"])
            paths = [p and {"cost": p[0], "audit": p[1]} for line in table for p in line]
            out.append(
                {"c": x["c"], "part": x["part"], "block": x["block"], "n": sum(r[2] for r in rows), "blank": count[BLANK], "repeated": count[REPEATED]}
                | {"truncated": count[TRUNCATED], "illegal": illegal, "head": rows[0][0], "tail": before, "paths": paths}
            )
        yield pa.RecordBatch.from_pylist(out, schema)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each conversation, and the letters of each of its blocks with the place they begin at."""
    piece = pa.struct([("part", pa.int32()), ("block", pa.int64()), ("letters", pa.string()), ("place", pa.int64()), ("system", pa.int64())])
    schema = pa.schema([("c", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("pieces", pa.list_(piece))])
    for batch in batches:
        out = []
        for conversation in batch.to_pylist():
            blocks = conversation["blocks"]
            illegal = sum(b["illegal"] for b in blocks)
            illegal += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:]))
            tables = []
            for b in blocks:
                flat = [p and (p["cost"], p["audit"]) for p in b["paths"]]
                tables.append([flat[i : i + STATES] for i in range(0, len(flat), STATES)])
            cost, audit = decide(tables)
            # User and assistant turns come in pairs, so an odd number of turns begins with a system turn.
            system = (len(audit) - audit.count("D")) % 2
            pieces, at, place = [], 0, 0
            for k, b in enumerate(blocks):
                end, rows = at, 0
                while rows < b["n"]:
                    rows += audit[end] != "I"
                    end += 1
                letters = audit[at:] if k + 1 == len(blocks) else audit[at:end]
                pieces.append({"part": b["part"], "block": b["block"], "letters": letters, "place": place, "system": system})
                place += len(letters) - letters.count("D")
                at = end
            out.append({"c": conversation["c"], "illegal": illegal, "cost": cost, "audit": audit, "pieces": pieces})
        yield pa.RecordBatch.from_pylist(out, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of repaired conversations, with the keys of the rows their texts come from (none if inserted)."""
    schema = pa.schema(
        [("c", pa.string()), ("place", pa.int64()), ("said", pa.string())]
        + [("known", pa.int32()), ("at", pa.int64()), ("role", pa.string()), ("digest", pa.string())]
    )
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            rows, left, row = iter(x["rows"]), 0, None
            place = x["place"]
            for letter in x["letters"]:
                if letter != "I":
                    first = not left
                    if first:
                        row = next(rows)
                        left = row["copies"]
                    left -= 1
                    if letter == "D":
                        continue
                said = "assistant" if (place - x["system"]) % 2 else "user"
                turn = {"c": x["c"], "place": place, "said": said}
                if letter != "I":
                    turn |= {k: row[k] for k in ("known", "at", "role", "digest")}
                    if letter == "K":
                        turn["said"] = row["role"]
                out.append(turn)
                place += 1
        yield pa.RecordBatch.from_pylist(out, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of ``role:text`` lines of each conversation, from turns in order."""
    schema = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])
    name, state = None, None
    for b in batches:
        done = []
        for c, role, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            if c == name:
                state.update(b"\n")
            else:
                if name is not None:
                    done.append({"c": name, "repaired_sha256": state.hexdigest()})
                name, state = c, hashlib.sha256()
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if name is not None:
        yield pa.RecordBatch.from_pylist([{"c": name, "repaired_sha256": state.hexdigest()}], schema)


class Repair:
    """The repair of a table with conv_id, turn, role and text; each step is written once and read again.

    ``among`` is a table whose conversations are all reported, also those without a row in ``turns``."""

    def __init__(self, turns: DataFrame, among: DataFrame | None = None, block_rows: int = BLOCK_ROWS):
        spark = turns.sparkSession
        folder = work_dir(spark, "repair")

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return spark.read.parquet(f"{folder}/{name}")

        named = (turns if among is None else among).select("conv_id", _named(F.col("conv_id")).alias("c"))
        self.conversations = named.distinct()
        self.rows = kept(_rows(turns), "rows")
        self.blocks = kept(_blocks(kept(_faults(self.rows), "faults"), block_rows), "blocks")
        self.summaries = kept(self.blocks.mapInArrow(_summaries, _SUMMARY), "summaries")
        told = F.struct("part", "block", "n", "illegal", "head", "tail", "paths")
        blocks = F.array_sort(F.collect_list(told), lambda a, b: F.when(F.struct(a.part, a.block) < F.struct(b.part, b.block), -1).otherwise(1))
        pieces = "array<struct<part: int, block: bigint, letters: string, place: bigint, system: bigint>>"
        gathered = self.summaries.groupBy("c").agg(blocks.alias("blocks"))
        self.decided = kept(gathered.mapInArrow(_decided, f"c string, illegal long, cost long, audit string, pieces {pieces}"), "decided")

    def report(self) -> DataFrame:
        """c (a name of the conversation, never null), conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit."""
        turns = self.rows.where("known = 1").select("c", "at").distinct().groupBy("c")
        spans = turns.agg((F.max("at") - F.min("at") + 1 - F.count("at")).alias("gaps"))
        faults = {"blank": "blank", "repeated": "duplicate", "truncated": "truncated"}
        counts = self.summaries.groupBy("c").agg(*[F.sum(a).alias(b) for a, b in faults.items()])
        found = self.conversations.join(counts, "c", "left").join(spans, "c", "left").join(self.decided.drop("pieces"), "c", "left")
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return found.select("c", "conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"))

    def turns(self) -> DataFrame:
        """The turns of the repaired conversations: c, place (from 0), role and text."""
        pieces = self.decided.select("c", F.explode("pieces").alias("p")).select("c", "p.*")
        shape = "c string, place long, said string, known int, at long, role string, digest string"
        bare = self.blocks.select("c", "part", "block", "rows").join(pieces, ["c", "part", "block"]).mapInArrow(_turns, shape)
        text = F.coalesce("text", F.lit("")).alias("text")
        return bare.join(self.rows.drop("copies"), _ORDER, "left").select("c", "place", F.col("said").alias("role"), text)

    def digests(self) -> DataFrame:
        """c and repaired_sha256, of the lines ``role:text`` of each repaired conversation that has turns."""
        ordered = self.turns().repartition("c").sortWithinPartitions("c", "place").select("c", "role", "text")
        return ordered.mapInArrow(_digests, "c string, repaired_sha256 string")
