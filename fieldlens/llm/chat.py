"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. A rolling hash of each
turn prefix (two 63-bit sums of hashes of position, role and text) tells which
conversations are prefixes of longer ones; an anti-join keeps the maximal ones,
which are then rendered. Of equal conversations the smallest id stays.

Positions, prefix hashes and text offsets are running sums over range-partitioned
turns, so one conversation with a third of all turns spreads over a third of the
tasks. A rendered conversation is returned in parts of about ``PART_CHARS``.

Defined results: turns are ordered by turn, role and text (null turns first);
nulls come first, repeated rows are repeated turns; a null role or text is rendered as empty but
differs from an empty one; turns with a null conversation id are left out; ids may be
of any type that sorts; extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import running_sums

PART_CHARS = 1 << 16


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, rendered."""
    said = F.concat(F.lit("<|"), F.coalesce("_role", F.lit("")), F.lit("|>\n"), F.coalesce("_text", F.lit("")), F.lit("\n"))
    key = F.concat(*[F.coalesce(F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col("_role"), F.col("_text"))])
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("_g"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_chars", F.length(said).cast("long"))
    placed = running_sums(rows, "_g", ["_turn", "_role", "_text"], ["_one", "_chars"], "turns")
    placed = placed.select("_g", (F.col("_one_before") + 1).alias("_pos"), "_chars_before", said.alias("_said"), F.sha2(key, 256).alias("_digest"))
    hashed = placed.select("_g", "_pos", *[F.shiftrightunsigned(F.xxhash64("_pos", "_digest", F.lit(i)), 1).alias(f"_h{i}") for i in (1, 2)])
    rolled = running_sums(hashed, "_g", ["_pos"], ["_h1", "_h2"], "prefixes")
    wide = lambda i: F.pmod(F.col(f"_h{i}").cast("decimal(38,0)") + F.col(f"_h{i}_before"), F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")
    prefix = rolled.select("_g", "_pos", wide(1).alias("_x"), wide(2).alias("_y"))
    final = prefix.groupBy("_g").agg(F.max(F.struct("_pos", "_x", "_y")).alias("_f")).select("_g", "_f._pos", "_f._x", "_f._y")
    key = ["_pos", "_x", "_y"]
    # A prefix that more rows have than end there is a proper prefix of a longer one.
    met = prefix.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    ends = final.groupBy(*key).agg(F.count(F.lit(1)).alias("_ends"), F.min("_g").alias("_g"))
    longer = met.join(ends.select(*key, "_ends"), key).where("_rows > _ends").select(*key)
    kept = ends.join(longer, key, "left_anti").select("_g")
    part = F.floor(F.col("_chars_before") / part_chars).cast("int").alias("part")
    # A part has at most part_chars characters and one turn.
    parts = placed.join(kept, "_g", "left_semi").groupBy("_g", part).agg(F.sort_array(F.collect_list(F.struct("_pos", "_said"))).alias("_all"))
    return parts.select(F.col("_g").alias(conv_col), "part", F.size("_all").cast("long").alias("n_turns"), F.array_join(F.transform("_all", lambda x: x["_said"]), "").alias("text"))
