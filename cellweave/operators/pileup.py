"""Pileup: bases by position, candidates, coverage, cell counts, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.dna import cigar_ops


def aligned_bases(reads: DataFrame) -> DataFrame:
    """One row per aligned base of reads (tid, pos, cigar, seq, qual, ...): rpos, qpos, base, qscore, qdist; other columns stay.

    Matches advance both, insertions and soft clips the query, deletions and skips the reference; qdist is the distance to
    the nearer end of the query.
    """
    step = lambda s, x: F.struct(
        F.concat(s["out"], F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), s["r"].alias("r"), s["q"].alias("q")))).alias("out"),
        (s["r"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0)).alias("r"), (s["q"] + F.when(x["op"].isin("M", "I", "S", "=", "X"), x["len"]).otherwise(0)).alias("q"),
    )
    zero = F.struct(F.array().cast("array<struct<op:string,len:int,r:int,q:int>>").alias("out"), F.lit(0).alias("r"), F.lit(0).alias("q"))
    placed = reads.withColumn("block", F.explode(F.filter(F.aggregate(cigar_ops("cigar"), zero, step, lambda s: s["out"]), lambda x: x["op"].isin("M", "=", "X"))))
    each = placed.withColumn("k", F.explode(F.expr("sequence(0, block.len - 1)")))
    each = each.withColumn("rpos", F.expr("pos + block.r + k")).withColumn("qpos", F.expr("block.q + k"))
    return each.withColumn("base", F.expr("substring(seq, qpos + 1, 1)")).withColumn("qscore", F.expr("ascii(substring(qual, qpos + 1, 1)) - 33")).withColumn("qdist", F.expr("least(qpos, length(seq) - 1 - qpos)")).drop("block", "k")


def position_counts(bases: DataFrame, min_qual: int = 20) -> DataFrame:
    """tid, pos, ref: coverage, failed, barcodes (in all, by strand, and with the reference base), and by base total, barcodes (in all, by
    strand, and of those that have the reference base too), plus and minus counts, and with a column qdist the greatest distance to an end of the read; base, ref 0-3 for ACGT."""
    good = F.expr(f"base between 0 and 3 and qual >= {min_qual}")
    edges = "qdist" in bases.columns
    per = bases.groupBy("tid", "pos", "ref", "barcode").agg(
        F.count_if(good).alias("n"), F.count_if(~good).alias("failed"), F.count_if(good & (F.col("base") == F.col("ref"))).alias("refs"),
        F.count_if(good & (F.col("strand") == "+")).alias("plus"), F.count_if(good & (F.col("strand") == "-")).alias("minus"),
        *(F.max(F.when(good & (F.col("base") == b), F.col("qdist"))).alias(f"e{b}") for b in range(4) if edges),
        *(F.count_if(good & (F.col("base") == b) & (F.col("strand") == s)).alias(f"b{b}{n}") for b in range(4) for s, n in (("+", "p"), ("-", "m"))),
    )
    return per.groupBy("tid", "pos", "ref").agg(
        F.sum("n").alias("coverage"), F.sum("failed").alias("failed_count"), F.count_if(F.col("n") > 0).alias("barcodes"),
        F.count_if(F.col("plus") > 0).alias("plus_barcodes"), F.count_if(F.col("minus") > 0).alias("minus_barcodes"), F.count_if(F.col("refs") > 0).alias("ref_barcodes"),
        *(F.coalesce(F.max(f"e{b}"), F.lit(0)).alias(f"{x}_edge") for b, x in enumerate("ACGT") if edges),
        *(c for b, x in enumerate("ACGT") for c in (
            F.sum(F.col(f"b{b}p") + F.col(f"b{b}m")).alias(f"{x}_total"), F.count_if(F.col(f"b{b}p") + F.col(f"b{b}m") > 0).alias(f"{x}_barcodes"),
            F.count_if(F.col(f"b{b}p") > 0).alias(f"{x}_plus_barcodes"), F.count_if(F.col(f"b{b}m") > 0).alias(f"{x}_minus_barcodes"),
            F.count_if((F.col(f"b{b}p") + F.col(f"b{b}m") > 0) & (F.col("refs") > 0)).alias(f"{x}_with_ref_barcodes"),
            F.sum(f"b{b}p").alias(f"{x}_plus"), F.sum(f"b{b}m").alias(f"{x}_minus"))),
    )


def snv_candidates(positions: DataFrame, min_barcodes: int = 5, min_alt: int = 2, min_af: float = 0.01, min_edge: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """tid, pos, ref, alt, alt_count, ref_count: the most frequent other base with enough barcodes and, where positions know it, far enough from an end of a read.

    targets (tid, pos, target_alt): just those positions, with the alternative of the list."""
    if targets is not None:
        at = lambda c: F.element_at(F.array(*(F.col(f"{x}_total") for x in "ACGT")), F.col(c).cast("int") + 1)
        return positions.join(targets, ["tid", "pos"]).where("ref between 0 and 3").select("tid", "pos", "ref", F.col("target_alt").alias("alt"), at("target_alt").alias("alt_count"), at("ref").alias("ref_count"))
    edge = F.element_at(F.array(*(F.col(f"{x}_edge") for x in "ACGT")), F.col("best.alt") + 1) if "A_edge" in positions.columns else F.lit(min_edge)
    options = F.array(*(F.struct((-F.col(f"{x}_total")).alias("less"), F.lit(b).alias("alt"), F.col(f"{x}_barcodes").alias("bcs")) for b, x in enumerate("ACGT")))
    best = F.array_min(F.filter(options, lambda o: (o["alt"] != F.col("ref")) & (o["bcs"] >= min_alt)))
    ref = F.element_at(F.array(*(F.col(f"{x}_total") for x in "ACGT")), F.col("ref").cast("int") + 1)
    x = positions.where(f"barcodes >= {min_barcodes} and ref between 0 and 3").withColumn("best", best).where("best is not null")
    x = x.where(edge >= min_edge).select("tid", "pos", "ref", F.col("best.alt").alias("alt"), (-F.col("best.less")).alias("alt_count"), ref.alias("ref_count"))
    return x.where(F.expr(f"alt_count >= {min_af} * (alt_count + ref_count)"))


def number_snvs(snvs: DataFrame) -> DataFrame:
    """snp: 0, 1, ... by tid and pos: ranks within a contig plus the counts of the contigs before, so that no sort holds all rows."""
    upto = snvs.groupBy("tid").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("tid")) - F.col("n")).drop("n")
    return snvs.join(F.broadcast(upto), "tid").withColumn("snp", F.col("first") + F.row_number().over(Window.partitionBy("tid").orderBy("pos")) - 1).drop("first")


def cell_base_counts(bases: DataFrame, snvs: DataFrame, min_qual: int = 20) -> DataFrame:
    """tid, pos, barcode, base, plus, minus at the given positions."""
    return bases.where(f"qual >= {min_qual}").join(snvs.select("tid", "pos").distinct(), ["tid", "pos"], "left_semi").groupBy("tid", "pos", "barcode", "base").agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))


def barcode_coverage(bases: DataFrame, min_qual: int = 20) -> DataFrame:
    return bases.where(f"qual >= {min_qual}").groupBy("barcode").agg(F.countDistinct("tid", "pos").alias("bases_covered"), F.count("*").alias("bases"))


def consensus(bases: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """keys: base (0-3, 4 N, 5 deletion), qual, depth: the plurality, of equal ones the least class, if its share is high enough, else N with quality 0."""
    per = bases.groupBy(*keys, "base").agg(F.count("*").alias("n"), F.max("qual").alias("q"))
    top = per.groupBy(*keys).agg(F.sum("n").alias("depth"), F.min(F.struct((-F.col("n")).alias("less"), "base", "q")).alias("b"))
    ok = F.expr(f"-b.less >= {share} * depth")
    return top.select(*keys, F.when(ok, F.col("b.base")).otherwise(4).alias("base"), F.when(ok, F.col("b.q")).otherwise(0).alias("qual"), "depth")


def insertion_consensus(insertions: DataFrame, coverage: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """keys, ins, support: insertions supported by enough of the coverage (keys, depth); of several the most frequent, then the least string."""
    per = insertions.groupBy(*keys, "ins").agg(F.count("*").alias("support"))
    best = per.groupBy(*keys).agg(F.min(F.struct((-F.col("support")).alias("less"), "ins")).alias("b"))
    return best.join(coverage, keys).where(F.expr(f"-b.less >= {share} * depth")).select(*keys, F.col("b.ins").alias("ins"), (-F.col("b.less")).alias("support"))


REGION_FLAGS = {"C": 1, "E": 2, "5": 4, "3": 8, "N": 16, "I": 32}


def region_labels(positions: DataFrame, overlaps: DataFrame) -> DataFrame:
    """tid, pos, region: flags of all overlaps (tid, pos, region_kind) united by bit, decoded by priority; '-' for none."""
    flag = F.create_map(*(F.lit(x) for kv in REGION_FLAGS.items() for x in kv))
    bits = overlaps.groupBy("tid", "pos").agg(F.bit_or(flag[F.col("region_kind")]).alias("bits"))
    pick = F.lit("-")
    for label, value in reversed(REGION_FLAGS.items()):
        pick = F.when(F.col("bits").bitwiseAND(value) != 0, label).otherwise(pick)
    return positions.join(bits, ["tid", "pos"], "left").withColumn("region", pick).drop("bits")
