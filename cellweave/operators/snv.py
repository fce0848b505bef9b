"""SNVs: stranded calls, co-occurrence, occupancy, merging of tools, predicates and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.dna import complement, is_transition, substitution


def stranded_calls(snvs: DataFrame, purity: float = 0.95, strand_purity: float = 0.9) -> DataFrame:
    """snvs (ref, alt, ref_plus, ref_minus, alt_plus, alt_minus, total) with purity, strand, strand_ref, strand_alt, strand_af, passed."""
    both = F.expr("ref_plus + ref_minus + alt_plus + alt_minus")
    x = snvs.withColumn("purity", both / F.expr("nullif(total, 0)")).withColumn("strand_purity", F.expr("(ref_plus + alt_plus) / nullif(ref_plus + ref_minus + alt_plus + alt_minus, 0)"))
    x = x.withColumn("strand", F.when(F.col("strand_purity") >= strand_purity, "+").when(F.col("strand_purity") <= F.lit(1 - strand_purity) + 1e-12, "-").otherwise("?"))
    minus = F.col("strand") == "-"
    x = x.withColumn("strand_ref", F.when(minus, complement("ref")).otherwise(F.col("ref"))).withColumn("strand_alt", F.when(minus, complement("alt")).otherwise(F.col("alt")))
    af = F.expr("case strand when '-' then alt_minus / nullif(alt_minus + ref_minus, 0) when '+' then alt_plus / nullif(alt_plus + ref_plus, 0) else (alt_plus + alt_minus) / nullif(ref_plus + ref_minus + alt_plus + alt_minus, 0) end")
    return x.withColumn("strand_af", af).withColumn("passed", F.coalesce((F.col("purity") >= purity) & (F.col("strand") != "?"), F.lit(False)))


def pair_tables(calls: DataFrame) -> DataFrame:
    """s1, s2, rr, aa, ra, ar from calls (molecule, snv, alt 0/1): allele pairs of two SNVs seen in one molecule.

    ra: first ref, second alt.  The pairs of one molecule are what is asked for; a molecule covers as many SNVs as its reads are long."""
    b = calls.select("molecule", F.col("snv").alias("s2"), F.col("alt").alias("a2"))
    x = calls.select("molecule", F.col("snv").alias("s1"), F.col("alt").alias("a1")).join(b, "molecule").where("s1 < s2")
    return x.groupBy("s1", "s2").agg(*(F.count_if((F.col("a1") == p) & (F.col("a2") == q)).alias(n) for n, p, q in (("rr", 0, 0), ("aa", 1, 1), ("ra", 0, 1), ("ar", 1, 0))))


def snv_sets(calls: DataFrame) -> DataFrame:
    """snv_set (sorted, joined by commas), molecules: the sets of SNVs that molecules cover."""
    one = calls.groupBy("molecule").agg(F.array_join(F.array_sort(F.collect_set("snv")), ",").alias("snv_set"))
    return one.groupBy("snv_set").agg(F.count("*").alias("molecules"))


def occupancy(counts: DataFrame) -> DataFrame:
    """snv: any, both, ref_only, alt_only barcodes from counts (snv, barcode, ref_n, alt_n)."""
    return counts.groupBy("snv").agg(F.count_if(F.expr("ref_n + alt_n > 0")).alias("any"), F.count_if(F.expr("ref_n > 0 and alt_n > 0")).alias("both"), F.count_if(F.expr("ref_n > 0 and alt_n = 0")).alias("ref_only"), F.count_if(F.expr("ref_n = 0 and alt_n > 0")).alias("alt_only"))


def align_counts(ref: DataFrame, alt: DataFrame) -> DataFrame:
    """Full outer join of two sparse matrices (snv, barcode, value), zero-filled."""
    r, a = ref.withColumnRenamed("value", "ref_n"), alt.withColumnRenamed("value", "alt_n")
    return r.join(a, ["snv", "barcode"], "full_outer").select("snv", "barcode", F.coalesce("ref_n", F.lit(0)).alias("ref_n"), F.coalesce("alt_n", F.lit(0)).alias("alt_n"))


def merge_tools(samples: DataFrame, tools: list[str]) -> DataFrame:
    """chrom, pos, alt and a 0/1 column per tool: the union of tools, of equal (chrom, pos, alt) and then (chrom, pos) the last tool's."""
    order = F.array_position(F.array(*map(F.lit, tools)), F.col("tool"))
    s = samples.withColumn("turn", order)
    w1 = Window.partitionBy("chrom", "pos", "alt").orderBy(F.desc("turn"))
    w2 = Window.partitionBy("chrom", "pos").orderBy(F.desc("turn"), F.desc("alt"))
    kept = s.withColumn("r", F.row_number().over(w1)).where("r = 1").withColumn("r", F.row_number().over(w2)).where("r = 1").select("chrom", "pos", "alt")
    seen = samples.groupBy("chrom", "pos").pivot("tool", tools).agg(F.lit(1))
    return kept.join(seen, ["chrom", "pos"], "left").select("chrom", "pos", "alt", *(F.coalesce(F.col(f"`{t}`"), F.lit(0)).alias(f"tool_{i}") for i, t in enumerate(tools)))


def genome_union(annotated: DataFrame, genome: DataFrame) -> DataFrame:
    """Full outer join on (chrom, pos) without positions whose alleles conflict; genome: 1 where the genome has it."""
    g = genome.select("chrom", "pos", F.col("alt").alias("g_alt"))
    x = annotated.join(g, ["chrom", "pos"], "full_outer").where("alt is null or g_alt is null or alt = g_alt")
    return x.select("chrom", "pos", F.coalesce("alt", "g_alt").alias("alt"), F.col("g_alt").isNotNull().cast("int").alias("genome"))


def coverage_intersection(coverage: DataFrame, genome: DataFrame) -> DataFrame:
    return coverage.select("chrom", "pos").intersect(genome.select("chrom", "pos"))


#: Named predicates over annotated SNVs (ref, alt of their strand, known, g1000, captured, rediportal, rep_family).
PREDICATES: dict[str, Callable[[], Column]] = {
    "g1000": lambda: F.col("g1000"),
    "A_to_G_edit": lambda: (F.col("ref") == "A") & (F.col("alt") == "G") & (F.col("rediportal") | F.coalesce(F.col("rep_family").contains("Alu"), F.lit(False))),
    "germline": lambda: F.col("known").contains("germline") | F.col("known").contains("WGS"),
    "somatic": lambda: F.col("known").contains("somatic"),
    "captured": lambda: F.col("captured"),
    "raw": lambda: F.col("known").contains("raw"),
    "transition": lambda: is_transition("ref", "alt"),
    "transversion": lambda: substitution("ref", "alt").isin("A>C", "C>A", "G>T", "T>G", "C>G", "G>C", "A>T", "T>A"),
}


class GroupBuilder:
    """Groups of SNVs as conjunctions of named predicates; ~name negates."""

    def __init__(self) -> None:
        self.groups: list[tuple[str, str, Column]] = []

    def add_group(self, short: str, name: str, *terms: str) -> GroupBuilder:
        test = F.lit(True)
        for t in terms:
            p = PREDICATES[t.lstrip("~")]()
            test = test & F.coalesce(~p if t[0] == "~" else p, F.lit(False))
        self.groups.append((short, name, test))
        return self

    def label(self) -> Column:
        """The short names of all matching groups, joined by commas."""
        return F.concat_ws(",", *(F.when(test, short) for short, _, test in self.groups))


def export_filter(snvs: DataFrame, mode: str = "all", max_af: float = 0.999) -> DataFrame:
    """mode: all, remove-edits, only-edits, keep-annotated, keep-unannotated."""
    edit = PREDICATES["A_to_G_edit"]()
    noted = (F.col("known") != "") | F.col("g1000")
    test = {"all": F.lit(True), "remove-edits": ~edit, "only-edits": edit, "keep-annotated": noted, "keep-unannotated": ~noted & ~edit}[mode]
    return snvs.where((F.col("strand_af") <= max_af) & test)


def overlap_summary(snvs: DataFrame) -> DataFrame:
    """Counts by substitution and captured with subtotals (null: all): only tool 1, only tool 2, both."""
    x = snvs.withColumn("sub", substitution("ref", "alt"))
    return x.cube("sub", "captured").agg(F.count_if(F.expr("tool1 and not tool2")).alias("tool1_only"), F.count_if(F.expr("tool2 and not tool1")).alias("tool2_only"), F.count_if(F.expr("tool1 and tool2")).alias("overlap"))
