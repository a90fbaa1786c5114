"""Chat formatting with cumulative snapshots collapsed, in DataFrame functions only.

Loggers often store a conversation again after every turn. A conversation whose turns are the first turns of a
longer one is such a snapshot; only maximal conversations are rendered, and of equal ones the one with the
least id.

Every turn gets two 64-bit hashes of its place, role and text; the prefix hash of a turn is the running
exclusive-or of these up to it. The last prefix hash of a snapshot is an inner prefix hash of the longer
conversation, so two anti-joins on distinct hashes remove snapshots and copies. Before they are joined both
sides are combined to distinct values, so a first turn that many conversations share is one row.

A long conversation is numbered and hashed in blocks of its turns, blocks after each other, and rendered
in parts of ``PART_TURNS`` turns, so no group grows with the number of conversations that look alike, nor with the length of
a conversation whose turns are numbered; turns with one number, or none, are one block. Texts are hashed where they are
read and move once, to meet the turns that are kept.

Turns are ordered by ``turn`` (null first), then role, then a hash of the text. Rows equal in conversation,
turn, role and text count once. Null role or text counts as empty. Rows without a conversation id are not
rendered. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut_lineage

#: A block holds the turns of 2 ** BLOCK_BITS values of ``turn``.
BLOCK_BITS = 6
PART_TURNS = 256
_TURN = ["conv_id", "turn", "role", "t1", "t2"]


def _rows(turns: DataFrame) -> DataFrame:
    """The turns with nulls filled and two hashes of role and text."""
    filled = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    return filled.withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit("second"), "text", "role")})


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """The distinct turns (conv_id, turn, role, t1, t2) with pos (from 0), last (the greatest pos of the
    conversation) and the rolling hashes h1 and h2 of all turns up to each."""
    distinct = _rows(turns).select(*_TURN, F.shiftright("turn", BLOCK_BITS).alias("block")).distinct()
    block, conversation = ["conv_id", "block"], Window.partitionBy("conv_id")
    before = conversation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        distinct.groupBy(block)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), (F.sum("n").over(conversation) - 1).alias("last"))
    )
    inside = F.row_number().over(Window.partitionBy(block).orderBy("turn", "role", "t1", "t2"))
    placed = distinct.withColumn("inside", inside).join(sizes, block)
    placed = cut_lineage(placed.select(*_TURN, "block", "last", (F.col("base") + F.col("inside") - 1).alias("pos")))
    hashed = placed.withColumns({"x1": F.xxhash64("pos", "t1"), "x2": F.xxhash64("t2", "pos")})
    carried = (
        hashed.groupBy(block)
        .agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
        .select(*block, *(F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    )
    running = Window.partitionBy(block).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({f"r{k}": F.bit_xor(f"x{k}").over(running) for k in (1, 2)})
    return rolled.join(carried, block).select(
        *_TURN, "pos", "last", *(F.col(f"r{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"h{k}") for k in (1, 2))
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no prefix of a longer one, one of each set of equal ones."""
    key = ["pos", "h1", "h2"]
    whole = prefixes.where("pos = last").groupBy(key).agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.where("pos < last").select(key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id")


def chatml(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render(turns: DataFrame, template=chatml, part_turns: int = PART_TURNS) -> DataFrame:
    """Maximal conversations as text: conv_id, part (from 0), n_turns and text. The texts of the parts of
    a conversation, in order, are its whole text; ``template`` makes the text of one turn."""
    prefixes = cut_lineage(prefix_hashes(turns))
    kept = prefixes.join(maximal(prefixes), "conv_id", "left_semi").select(*_TURN, "pos")
    texts = _rows(turns).groupBy(_TURN).agg(F.min("text").alias("text"))
    part = F.floor(F.col("pos") / part_turns).cast("long")
    pieces = F.array_sort(F.collect_list(F.struct("pos", template(F.col("role"), F.col("text")).alias("piece"))))
    return (
        texts.join(kept, _TURN)
        .groupBy("conv_id", part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(pieces, lambda x: x.piece), "").alias("text"))
    )
