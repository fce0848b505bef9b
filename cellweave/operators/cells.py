"""Cell calling: ranks, cumulative share, knee, outliers by median absolute deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consistency constant of the scaled median absolute deviation.
MAD_SCALE = 0.6744897501960817


def ranked(rates: DataFrame) -> DataFrame:
    """barcode, molecules, rnk (1 for the most molecules, then by barcode), cum: molecules up to the rank.

    Two levels, so that no window holds all cells: counts of cells by molecules (a short table) give the cells and molecules above a
    level, a window within a level the rest."""
    up = Window.orderBy(F.desc("molecules"))
    levels = rates.groupBy("molecules").agg(F.count("*").alias("n"))
    levels = levels.withColumn("above", F.sum("n").over(up) - F.col("n")).withColumn("more", F.sum(F.expr("n * molecules")).over(up) - F.expr("n * molecules"))
    within = F.row_number().over(Window.partitionBy("molecules").orderBy("barcode"))
    x = rates.join(levels, "molecules").withColumn("at", within)
    return x.select("barcode", "molecules", F.expr("above + at").alias("rnk"), F.expr("more + at * molecules").alias("cum"))


def knee(rank: DataFrame) -> DataFrame:
    """rnk, molecules of the cell farthest from the chord between the first and the last (log10 rank, cumulative share)."""
    ends = rank.agg(F.max("rnk").alias("n"), F.max("cum").alias("all"), F.min(F.struct("rnk", "cum")).alias("f"))
    x = rank.join(F.broadcast(ends)).withColumn("x", F.log10("rnk")).withColumn("y", F.col("cum") / F.col("all"))
    x = x.withColumn("gap", F.expr("abs((1 - f.cum / all) * x - log10(n) * (y - f.cum / all)) / sqrt(pow(1 - f.cum / all, 2) + pow(log10(n), 2))"))
    return x.agg(F.max(F.struct(F.round("gap", 9).alias("gap"), (-F.col("rnk")).alias("less"), "molecules")).alias("k")).select((-F.col("k.less")).alias("rnk"), F.col("k.molecules").alias("molecules"))


def median_mad(rows: DataFrame, value: str) -> DataFrame:
    """med, mad (scaled) of a column; exact percentiles."""
    med = rows.agg(F.percentile(value, 0.5).alias("med"))
    return rows.join(F.broadcast(med)).agg(F.first("med").alias("med"), (F.percentile(F.abs(F.col(value) - F.col("med")), 0.5) / MAD_SCALE).alias("mad"))


def mad_filter(rows: DataFrame, value: str, times: float, cap: float, low: bool) -> DataFrame:
    """Rows not lower (low) or not higher than the median by the lesser of times MADs and cap."""
    m = rows.join(F.broadcast(median_mad(rows, value)))
    reach = F.least(F.col("mad") * times, F.lit(float(cap)))
    return m.where(F.col(value) >= F.col("med") - reach if low else F.col(value) <= F.col("med") + reach).drop("med", "mad")


def call_cells(rates: DataFrame, least: int = 750, mt_percent: float = 25, dup: tuple = (5, 10), saturation: tuple = (3, 10), corrected: tuple = (10, 1.5)) -> DataFrame:
    """Cells from rates (barcode, molecules, reads, mt_percent, dup_percent, saturation, corrected_percent) that pass all filters in turn."""
    x = rates.where((F.col("molecules") >= least) & (F.col("mt_percent") <= mt_percent))
    x = mad_filter(x, "dup_percent", *dup, low=True)
    x = mad_filter(x, "saturation", *saturation, low=True)
    return mad_filter(x, "corrected_percent", *corrected, low=False)


def quartiles(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.agg(*(F.percentile(v, [0.25, 0.5, 0.75]).alias(f"{v}_q") for v in values)).select(*(F.col(f"{v}_q")[i].alias(f"{v}_q{i + 1}") for v in values for i in range(3)))


def suffix_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """unique_name: names that occur more than once get -1, -2, ... in order."""
    w = Window.partitionBy(name)
    return rows.withColumn("unique_name", F.when(F.count("*").over(w) > 1, F.concat_ws("-", name, F.row_number().over(w.orderBy(*order)).cast("string"))).otherwise(F.col(name)))
