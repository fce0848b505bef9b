"""Sessions by gap and by overlap, merged blocks and the gaps between them.

Sessions of a key are found tile by tile: rows are windowed within tiles of positions, and only the tiles (a short table, one
row for each) are windowed by key, so that a contig with a third of all rows is as many tasks as it has tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a tile.
TILE = 1 << 20


def gap_groups(rows: DataFrame, keys: list[str], pos: str, most: int, ties: list[str]) -> DataFrame:
    """session: numbered from 0 within keys; a new one when the gap to the row before is over most."""
    return overlap_groups(rows, keys, pos, pos, ties, most)


def overlap_groups(rows: DataFrame, keys: list[str], lft: str, rgt: str, ties: list[str], touch: int = 0) -> DataFrame:
    """session: a new one when lft lies more than touch behind the greatest rgt so far (0: closed ranges that share a position)."""
    tiled = rows.withColumn("tile", F.floor(F.col(lft) / TILE))
    by = [*keys, "tile"]
    within = Window.partitionBy(*by).orderBy(lft, rgt, *ties)
    tiles = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)

    def with_tiles(x: DataFrame, table: DataFrame) -> DataFrame:
        other = table.select(*(F.col(k).alias(f"of_{k}") for k in by), *(c for c in table.columns if c not in by))
        match = F.lit(True)
        for k in by:
            match = match & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        return x.join(other, match).drop(*(f"of_{k}" for k in by))

    reach = tiled.groupBy(*by).agg(F.max(rgt).alias("reach")).withColumn("reach", F.max("reach").over(tiles))
    x = with_tiles(tiled, reach)
    before = F.greatest(F.max(rgt).over(within.rowsBetween(Window.unboundedPreceding, -1)), "reach")
    x = x.withColumn("new", F.when(F.col(lft) > before + touch, 1).otherwise(0)).drop("reach")
    first = x.groupBy(*by).agg(F.sum("new").alias("first")).withColumn("first", F.coalesce(F.sum("first").over(tiles), F.lit(0)))
    x = with_tiles(x, first)
    return x.withColumn("session", F.col("first") + F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "first", "tile")


def merged_blocks(rows: DataFrame, keys: list[str], lft: str, rgt: str) -> DataFrame:
    """keys, block, lft, rgt, n: unions of overlapping closed ranges."""
    return overlap_groups(rows, keys, lft, rgt, []).groupBy(*keys, F.col("session").alias("block")).agg(F.min(lft).alias("lft"), F.max(rgt).alias("rgt"), F.count("*").alias("n"))


def block_gaps(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lft, rgt of what lies between the blocks of a key."""
    w = Window.partitionBy(*keys).orderBy("lft")
    return blocks.withColumn("next", F.lead("lft").over(w)).where("next > rgt + 1").select(*keys, F.expr("rgt + 1").alias("lft"), F.expr("next - 1").alias("rgt"))


def cap_sessions(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows of sessions with at most so many rows (the others are dropped as a whole: that is the feature)."""
    return rows.withColumn("n_in", F.count("*").over(Window.partitionBy(*keys))).where(F.col("n_in") <= most).drop("n_in")
