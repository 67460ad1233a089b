"""Chat formatting with the collapse of cumulative snapshots.

Loggers often write a conversation again after every turn. A rolling hash of the turns so far (each
turn's hash covers its place, role and text; two 64-bit sums, exclusive-or'ed along the turns) gives
every prefix of a conversation a key. A conversation whose whole key is a proper prefix of another
one goes, by an anti-join; of equal conversations the one with the smallest id stays. The rest is
rendered, one string a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are empty."""
    return conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def key(number: int, place: Column) -> Column:
    """One of the two hashes of a turn at a place."""
    return F.xxhash64(F.lit(number), place, "role", "text")


def with_prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), role, text, h1, h2: the keys of the turns up to this one."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumns({f"t{i}": key(i, F.col("place")) for i in (1, 2)})
    return rows.withColumns({f"h{i}": F.bit_xor(f"t{i}").over(so_far) for i in (1, 2)}).drop("t1", "t2", "turn")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of conversations that are no proper prefix of another, once each."""
    ends = turns.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("end")).select("conv_id", "end.*")
    unique = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    last = ends.select(F.col("conv_id").alias("c"), F.col("place").alias("n"))
    longer = turns.join(last, F.col("conv_id") == F.col("c")).filter("place < n")
    prefixes = longer.select("place", "h1", "h2").distinct()
    return unique.join(prefixes, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, rendered of every maximal conversation.

    Turns are ordered by number (null first), then role, then text; repeated turn rows all count. Null
    roles and texts count as empty. A row of a null conv_id is a conversation of one turn; of equal ones
    one row stays, if no other conversation begins with it. An empty table gives no rows; further columns
    are ignored. One conversation is one string, so it has to fit in memory.
    """
    rows = turns(conversations, id_col, turn_col, role_col, text_col)
    known = with_prefixes(rows.filter(F.col("conv_id").isNotNull()))
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END), F.lit("\n"))
    kept = maximal_conversations(known).withColumnsRenamed({"conv_id": "kept_id"})
    lines = known.join(kept, F.col("conv_id") == F.col("kept_id")).select("conv_id", "n_turns", F.struct("place", line.alias("line")).alias("turn"))
    grouped = lines.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.array_sort(F.collect_list("turn")).alias("turns"))
    named = grouped.select("conv_id", "n_turns", F.array_join(F.col("turns.line"), "").alias("rendered"))

    nameless = rows.filter(F.col("conv_id").isNull()).select("conv_id", line.alias("rendered"), *[key(i, F.lit(1)).alias(f"h{i}") for i in (1, 2)])
    once = nameless.groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.min("rendered").alias("rendered"))
    begun = known.filter("place = 1").select("h1", "h2").distinct()
    return named.unionByName(once.join(begun, ["h1", "h2"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("n_turns"), "rendered"))
