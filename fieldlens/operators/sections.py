"""The tree of sections of a document, from its blocks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(blocks: DataFrame, doc: str, idx: str = "block_idx", level: str = "level", end: str = "source_end_line", deepest: int = 6) -> DataFrame:
    """Blocks with ``parent`` (idx of the heading that they stand under, null at the
    top), ``ordinal`` (of a heading among its parent's headings of that level, from 0)
    and ``section_end`` (of a heading, the last line of its section). ``level`` is null
    for blocks that are no headings. A heading ends all sections of its level and deeper.
    Two running passes over each document, one from either end; nothing is gathered."""
    forward, backward = (Window.partitionBy(doc).orderBy(o) for o in (F.col(idx), F.desc(idx)))
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own, at = F.col(level), F.col(idx)
    last = lambda test: F.max(F.when(test, at)).over(before)
    opened = []
    for n in range(1, deepest + 1):
        here, shallower = last(own == n), last(own < n)
        is_open = here.isNotNull() & (shallower.isNull() | (here > shallower))
        opened.append(F.when(is_open & (own.isNull() | (own > n)), here))
    # Headings of a level or a shallower one cut the document into stretches; a heading's
    # section is the stretch of its own level that it begins. Numbers fall from stretch to
    # stretch, so the greatest that was met from the end is the present one.
    stretches = {f"_s{n}": -F.sum(F.when(own <= n, 1).otherwise(0)).over(upto(forward)) for n in range(1, deepest + 1)}
    placed = blocks.withColumns({"parent": F.greatest(*opened)} | stretches)
    ends = F.when(own.isNull(), None)
    for n in range(1, deepest + 1):
        ends = ends.when(own == n, F.max(F.struct(F.col(f"_s{n}"), F.col(end).alias("e"))).over(upto(backward))["e"])
    among = Window.partitionBy(doc, "parent", level).orderBy(idx)
    return placed.withColumn("section_end", ends).drop(*stretches).withColumn("ordinal", F.when(own.isNotNull(), F.row_number().over(among) - 1))
