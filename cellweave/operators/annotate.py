"""Annotations of SNVs: calls of other tools, known variants, edits, repeats; what passes and what doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import interval_join


def known_names(snvs: DataFrame, calls: DataFrame) -> DataFrame:
    """snvs with known: sources of all calls with equal chrom, pos, ref and alt, sorted and joined by commas ('' for none)."""
    keys = ["chrom", "pos", "ref", "alt"]
    names = calls.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("known"))
    return snvs.join(names, keys, "left").withColumn("known", F.coalesce("known", F.lit("")))


def listed(snvs: DataFrame, table: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """snvs with a flag: whether the table has their keys (1000 Genomes: chrom, pos, alt)."""
    seen = table.select(*keys).distinct().withColumn(flag, F.lit(True))
    return snvs.join(seen, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def edits(snvs: DataFrame, table: DataFrame) -> DataFrame:
    """snvs with rediportal: an A to G change of their strand at a listed chrom and pos."""
    x = listed(snvs, table, ["chrom", "pos"], "rediportal")
    return x.withColumn("rediportal", F.col("rediportal") & F.coalesce(F.expr("strand_ref = 'A' and strand_alt = 'G'"), F.lit(False)))


REPEAT = ("rep_name", "rep_class", "rep_family", "rep_strand")


def repeats(snvs: DataFrame, table: DataFrame) -> DataFrame:
    """snvs (chrom, pos) with four attributes of all repeats (chrom, lft, rgt, closed) over them: lists in order of lft, rgt and name, joined by commas; null for none."""
    hits = interval_join(snvs.select("chrom", "pos").distinct(), table.select("chrom", "lft", "rgt", *REPEAT), "chrom", ("pos", "pos"), ("lft", "rgt"))
    lists = hits.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("lft", "rgt", *REPEAT))).alias("all"))
    lists = lists.select("chrom", "pos", *(F.array_join(F.col(f"all.{c}"), ",").alias(c) for c in REPEAT))
    return snvs.join(lists, ["chrom", "pos"], "left")


def without_failed(calls: DataFrame, failed_snvs: DataFrame, failed_barcodes: DataFrame) -> DataFrame:
    """Calls (snv, barcode, ...) of neither a failed SNV nor a failed barcode."""
    return calls.join(failed_snvs.select("snv").distinct(), "snv", "left_anti").join(failed_barcodes.select("barcode").distinct(), "barcode", "left_anti")


def filtering(snvs: DataFrame) -> DataFrame:
    """passed and failed SNVs by reason: reason (passed, purity, strand), count, from columns purity_ok and strand_ok."""
    reason = F.when(~F.col("purity_ok"), "purity").when(~F.col("strand_ok"), "strand").otherwise("passed")
    return snvs.groupBy(reason.alias("reason")).agg(F.count("*").alias("count"))


def with_results(results: DataFrame, notes: DataFrame, flags: list[str], columns: list[str] | None = None) -> DataFrame:
    """results left-joined to notes on chrom and pos, flags of SNVs that notes doesn't have false; only the given columns of notes, if any are."""
    picked = notes.select("chrom", "pos", *columns) if columns else notes
    return results.join(picked, ["chrom", "pos"], "left").fillna(False, flags)


def set_ids(sets: DataFrame) -> DataFrame:
    """snv_set, molecules with set_id 0, 1, ... by molecules (most first), then snv_set.

    Two levels, so that no window holds all sets: counts by molecules are a short table."""
    from pyspark.sql import Window

    levels = sets.groupBy("molecules").agg(F.count("*").alias("n"))
    levels = levels.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("molecules"))) - F.col("n")).drop("n")
    return sets.join(levels, "molecules").withColumn("set_id", F.col("above") + F.row_number().over(Window.partitionBy("molecules").orderBy("snv_set")) - 1).select("snv_set", "molecules", "set_id")
