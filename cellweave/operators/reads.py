"""Alignments: filters and attribution to genes, regions, rewritten UMIs, result rates, histograms, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.dna import cigar_ops

from .joins import interval_join, overlap_totals, small
from .sessionize import overlap_groups

#: Results of reads, in the order of reports.
RESULTS = "CDNA INTRONIC INTERGENIC AMBIGUOUS ANTISENSE MULTIMAPPED UNMAPPED BARCODE_FAIL UMI_FAIL TAG_FAIL".split()
#: Upper ends of the counters of histograms.
MOST_READS, MOST_BASES = 65535, 1000


def tag_strand(reverse: Column, forward_library: bool) -> Column:
    """Strand of the tag from the strand of its alignment and the library's direction."""
    return F.when(reverse != F.lit(forward_library), "+").otherwise("-")


def counted_reads(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """Reads (RA, mapq, XG, ...) that count for a gene: RA E or N, mapping quality 255; gid of their gene_id (unknown genes drop out)."""
    return reads.where("RA in ('E', 'N') and mapq = 255").join(genes.select(F.col("gene_id").alias("XG"), "gid"), "XG")


def cellranger_reads(reads: DataFrame, genes: DataFrame, forward_library: bool = True) -> DataFrame:
    """Reads (id, contig, lft, rgt, reverse, mapq, CB, UB, RE, MM, GX) of another pipeline with XS and gid, of those that count.

    Mapping quality 255 with cell and UMI; exonic reads (RE = E, or no RE but GX) of one gene, not rescued (MM = 1) if RE says exonic;
    intronic ones (RE = N, or neither RE nor GX) that overlap just one gene (contig, g_lft, g_rgt, strand) of their strand.
    """
    good = reads.where("mapq = 255 and CB is not null and UB is not null and not coalesce(RE = 'E' and MM = 1, false)").withColumn("XS", tag_strand(F.col("reverse"), forward_library))
    exonic = good.where("RE = 'E' or (RE is null and GX is not null)").where("not contains(GX, ';')").join(small(genes.select(F.col("gene_id").alias("GX"), "gid")), "GX")
    inner = good.where("RE = 'N' or (RE is null and GX is null)")
    of = genes.select("contig", "g_lft", "g_rgt", "gid", F.col("strand").alias("XS"))
    near = overlap_totals(inner, of, ["contig", "XS"], ("lft", "rgt"), ("g_lft", "g_rgt"), "gid").withColumn("of_id", F.sum("n").over(Window.partitionBy("id", "XS")))
    names = [*good.columns, "gid"]
    return exonic.select(names).unionByName(near.where("of_id = 1").withColumnRenamed("total", "gid").select(names))


def genome_reads(reads: DataFrame, min_mapq: int = 20, duplicates: bool = True) -> DataFrame:
    """Reads of at least this mapping quality, without those marked dup unless asked for."""
    kept = reads.where(F.col("mapq") >= min_mapq)
    return kept if duplicates else kept.where("not dup")


def by_barcode(reads: DataFrame, passed: DataFrame) -> DataFrame:
    """Reads with bid of their cell barcode (CB without what follows a dash) among passed (barcode, bid)."""
    return reads.withColumn("barcode", F.substring_index("CB", "-", 1)).join(passed, "barcode")


def gene_bases(spans: DataFrame, genes: DataFrame, introns: DataFrame) -> DataFrame:
    """One row for each span (id, contig, lft, rgt, bases, xs) and gene (contig, gid, g_lft, g_rgt, strand) that overlap: exonic, intronic and intergenic bases.

    introns: gid, i_lft, i_rgt; all ranges are closed."""
    pairs = interval_join(spans, genes, "contig", ("lft", "rgt"), ("g_lft", "g_rgt")).withColumn("overlap", F.expr("least(rgt, g_rgt) - greatest(lft, g_lft) + 1"))
    cut = F.expr("case when i_lft < rgt and lft <= i_rgt then least(rgt, i_rgt) - greatest(lft, i_lft) + 1 else 0 end")
    inside = pairs.join(introns, "gid").groupBy("id", "gid").agg(F.sum(cut).alias("intronic"))
    out = pairs.join(inside, ["id", "gid"], "left").withColumn("intronic", F.coalesce("intronic", F.lit(0)))
    return out.select("id", "gid", "strand", "xs", F.expr("overlap - intronic").alias("exonic"), "intronic", F.expr("bases - overlap").alias("intergenic"))


def classify_spans(spans: DataFrame, genes: DataFrame, introns: DataFrame, tie: int = 5) -> DataFrame:
    """id, kind, gid of every span: genes of its strand within a tie of the most exonic bases decide.

    More than one is ambiguous; a single one is CDNA (25 exonic bases or more, fewer than 5 intronic), INTRON (5 intronic or
    more) or intergenic; with none of its strand the span is antisense, to a gene if there is one; without genes it is intergenic.
    """
    x = gene_bases(spans, genes, introns).withColumn("same", F.col("strand") == F.col("xs"))
    most = F.max("exonic").over(Window.partitionBy("id", "same"))
    near = x.withColumn("most", most).where(F.col("most") - F.col("exonic") < tie)
    per = near.groupBy("id").agg(F.count_if("same").alias("ovc"), F.count_if(~F.col("same")).alias("ova"), *(F.max(F.when(t, F.struct("exonic", "gid", "intronic"))).alias(n) for n, t in (("m", F.col("same")), ("a", ~F.col("same")))))
    kind = "case when ovc is null then 'INTERGENIC' when ovc > 1 then 'AMBIGUOUS' when ovc = 0 then 'ANTISENSE' when m.exonic >= 25 and m.intronic < 5 then 'CDNA' when m.intronic >= 5 then 'INTRON' else 'INTERGENIC' end"
    out = spans.select("id").join(per, "id", "left").withColumn("kind", F.expr(kind))
    return out.select("id", "kind", F.expr("case when kind in ('CDNA', 'INTRON') then m.gid when kind = 'ANTISENSE' and ova = 1 then a.gid end").alias("gid"))


def rewrite_umis(reads: DataFrame, umi_map: DataFrame, bad: DataFrame) -> DataFrame:
    """Reads (barcode, gene, umi, RA, ...) with corrected umi, UR (the one before, if corrected), and RA '?' where the corrected UMI is bad."""
    m = umi_map.where("umi <> umi_to").select("barcode", "gene", "umi", "umi_to")
    x = reads.join(m, ["barcode", "gene", "umi"], "left").withColumn("UR", F.when(F.col("umi_to").isNotNull(), F.col("umi"))).withColumn("umi", F.coalesce("umi_to", "umi")).drop("umi_to")
    b = bad.select("barcode", "gene", "umi", F.lit(True).alias("is_bad"))
    return x.join(b, ["barcode", "gene", "umi"], "left").withColumn("RA", F.when(F.col("is_bad"), "?").otherwise(F.col("RA"))).drop("is_bad")


def read_result(reads: DataFrame) -> DataFrame:
    """Reads with result: what fails first (barcode, UMI, tag, no alignment), else the result of classification (column kind)."""
    return reads.withColumn("result", F.expr("case when not barcode_ok then 'BARCODE_FAIL' when not umi_ok then 'UMI_FAIL' when not tag_ok then 'TAG_FAIL' when kind is null then 'UNMAPPED' else kind end"))


def result_rates(reads: DataFrame) -> DataFrame:
    """barcode and a column align_<result> of counts for each result; a corrected barcode counts in align_barcode_corrected."""
    x = reads.where("result <> 'BARCODE_FAIL'").groupBy("barcode").agg(
        *(F.count_if(F.col("result") == r).alias(f"align_{r.lower()}") for r in RESULTS if r != "BARCODE_FAIL"), F.count_if("corrected").alias("align_barcode_corrected"))
    return x


def alignment_summary(reads: DataFrame) -> DataFrame:
    """type, count, percent of all results, zero where there is none."""
    kinds = reads.sparkSession.createDataFrame([(r,) for r in RESULTS], "type string")
    n = reads.groupBy(F.col("result").alias("type")).agg(F.count("*").alias("count"))
    total = reads.agg(F.count("*").alias("total"))
    return kinds.join(n, "type", "left").join(F.broadcast(total)).select("type", F.coalesce("count", F.lit(0)).alias("count"), F.expr("100d * coalesce(count, 0) / nullif(total, 0)").alias("percent"))


def preferred_alignments(hits: DataFrame) -> DataFrame:
    """Hits (read, antisense, gene, score, transcript) with turn: sense first, then by gene, score (highest first) and transcript."""
    return hits.withColumn("turn", F.row_number().over(Window.partitionBy("read").orderBy("antisense", "gene", F.desc("score"), "transcript")))


def fragment_duplicates(molecules: DataFrame) -> DataFrame:
    """Molecules with dups: fragments of xr (start,end,cigar;...) less distinct (start, end)."""
    places = F.transform(F.split("xr", ";"), lambda t: F.concat_ws(",", F.split(t, ",")[0], F.split(t, ",")[1]))
    return molecules.withColumn("dups", F.size(places) - F.size(F.array_distinct(places)))


def base_histogram(molecules: DataFrame) -> DataFrame:
    """reads, pcr_dups, bases, count of molecules (reads, dups, bases), counters clamped to their ends; molecules without bases don't count."""
    clamp = lambda c, n: F.least(F.col(c), F.lit(n))
    x = molecules.where("bases > 0").select(clamp("reads", MOST_READS).alias("reads"), clamp("dups", MOST_READS).alias("pcr_dups"), clamp("bases", MOST_BASES).alias("bases"))
    return x.groupBy("reads", "pcr_dups", "bases").agg(F.count("*").alias("count"))


def barcode_max_bases(molecules: DataFrame) -> DataFrame:
    """barcode, max_bases, min_reads: the most bases of a molecule, and the fewest reads of those with as many."""
    top = molecules.groupBy("barcode").agg(F.min(F.struct((-F.col("bases")).alias("less"), "reads")).alias("b"))
    return top.select("barcode", (-F.col("b.less")).alias("max_bases"), F.col("b.reads").alias("min_reads"))


def merge_histograms(parts: list[DataFrame]) -> DataFrame:
    """Sum of several base_histogram tables."""
    from functools import reduce

    return reduce(DataFrame.unionByName, parts).groupBy("reads", "pcr_dups", "bases").agg(F.sum("count").alias("count"))


def merge_whitelists(known: DataFrame, more: DataFrame) -> DataFrame:
    """known (code, cnt) with the counts of more added; codes that only more has are left out."""
    add = more.groupBy("code").agg(F.sum("cnt").alias("extra"))
    return known.join(add, "code", "left").select("code", (F.col("cnt") + F.coalesce("extra", F.lit(0))).alias("cnt"))


def mixture_cells(molecules: DataFrame, cells: DataFrame) -> DataFrame:
    """molecules (filenum, barcode, ...) with the synthetic cell of their file and barcode (cells: cell, filenum, barcode); others drop out."""
    return molecules.join(cells, ["filenum", "barcode"])


def reassign_ambient(molecules: DataFrame, cells: int, share: float, seed: int = 42) -> DataFrame:
    """molecules (molecule, cell from 0) with to_cell: with probability share another cell, each as likely; drawn from a hash of the molecule and seed, so that reruns agree."""
    u = lambda salt: F.expr(f"(pmod(xxhash64(molecule, {seed}, {salt}), 1048576) + 0.5d) / 1048576d")
    other = (F.col("cell") + 1 + F.floor(u(2) * (cells - 1))) % cells
    return molecules.withColumn("to_cell", F.when(u(1) < share, other).otherwise(F.col("cell")).cast("bigint")) if cells > 1 else molecules.withColumn("to_cell", F.col("cell").cast("bigint"))


def mixture_counts(molecules: DataFrame) -> DataFrame:
    """cell: molecules that stayed (kept), came from other cells (ambient) and went to others (lost)."""
    here = molecules.groupBy(F.col("to_cell").alias("cell")).agg(F.count_if(F.expr("cell = to_cell")).alias("kept"), F.count_if(F.expr("cell <> to_cell")).alias("ambient"))
    gone = molecules.groupBy("cell").agg(F.count_if(F.expr("cell <> to_cell")).alias("lost"))
    return here.join(gone, "cell", "full_outer").select("cell", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "ambient", "lost")))


def read_snvs(bases: DataFrame, snvs: DataFrame) -> DataFrame:
    """molecule, snv, alt (0 or 1): listed SNVs (snv, tid, pos, strand, ref, alt) that a base (molecule, tid, pos, strand, base) shows; other bases don't count."""
    hit = bases.join(snvs.select("snv", "tid", "pos", "strand", F.col("ref").alias("snv_ref"), F.col("alt").alias("snv_alt")), ["tid", "pos", "strand"]).where("base = snv_ref or base = snv_alt")
    return hit.groupBy("molecule", "snv").agg(F.max(F.expr("if(base = snv_alt, 1, 0)")).alias("alt"))


def counts_at(positions: DataFrame, snvs: DataFrame) -> DataFrame:
    """Listed SNVs (tid, pos, ref, alt) with the reads of both alleles from position counts, zero where nothing covers them."""
    at = lambda c: F.coalesce(F.element_at(F.array(*(F.col(f"{x}_total") for x in "ACGT")), F.col(c).cast("int") + 1), F.lit(0))
    kept = positions.select("tid", "pos", "barcodes", *(f"{x}_total" for x in "ACGT"))
    return snvs.join(kept, ["tid", "pos"], "left").select("tid", "pos", "ref", "alt", at("ref").alias("ref_count"), at("alt").alias("alt_count"), F.coalesce("barcodes", F.lit(0)).alias("barcodes"))


def relative_exons(exons: DataFrame) -> DataFrame:
    """Exons (transcript, lft, rgt, strand) with rel_lft and rel_rgt in the transcript, from 0 in its direction, and intron: the bases to the next exon in genome order (null for the last)."""
    forward = F.col("strand") == "+"
    turn = Window.partitionBy("transcript").orderBy(F.when(forward, F.col("lft")).otherwise(-F.col("lft")))
    size = F.expr("rgt - lft + 1")
    upto = F.sum(size).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.lead("lft").over(Window.partitionBy("transcript").orderBy("lft")) - F.col("rgt") - 1
    return exons.withColumn("rel_lft", upto - size).withColumn("rel_rgt", upto - 1).withColumn("intron", gap)


def genome_counts(counts: DataFrame, organisms: DataFrame, names: list[str]) -> DataFrame:
    """barcode, and for each organism <name>_exonic and <name>_intronic molecules, from gene counts and organisms (gene, organism)."""
    x = counts.join(organisms, "gene").groupBy("barcode")
    return x.agg(*(F.coalesce(F.sum(F.when(F.col("organism") == o, F.col(c))), F.lit(0)).alias(f"{o}_{n}") for o in names for c, n in (("molecules", "exonic"), ("intronic", "intronic"))))


def collapse_counters(groups: DataFrame) -> DataFrame:
    """groups, ambiguous, lost, reads, dups of collapsed groups (ambiguous, lost: flags; reads, dups: counts)."""
    return groups.agg(F.count("*").alias("groups"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("lost").alias("lost"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum("dups"), F.lit(0)).alias("dups"))


def rescored(hits: DataFrame, match: int = 1, mismatch: int = 4, gap_open: int = 6, gap_extend: int = 1) -> DataFrame:
    """Hits (cigar, seq, ref: the reference from the first aligned base on, skips included) with score and nm.

    Equal bases score match, others (and N) cost mismatch; a gap costs its opening and each base; skips and clips cost nothing.
    """
    step = lambda s, x: F.struct(
        (s["r"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0)).alias("r"), (s["q"] + F.when(x["op"].isin("M", "I", "S", "=", "X"), x["len"]).otherwise(0)).alias("q"),
        (s["same"] + F.when(x["op"].isin("M", "=", "X"), _matches(s["r"], s["q"], x["len"])).otherwise(0)).alias("same"), (s["aligned"] + F.when(x["op"].isin("M", "=", "X"), x["len"]).otherwise(0)).alias("aligned"),
        (s["gaps"] + F.when(x["op"].isin("D", "I"), 1).otherwise(0)).alias("gaps"), (s["gapped"] + F.when(x["op"].isin("D", "I"), x["len"]).otherwise(0)).alias("gapped"),
    )
    zero = F.struct(*(F.lit(0).alias(c) for c in ("r", "q", "same", "aligned", "gaps", "gapped")))
    x = hits.withColumn("tally", F.aggregate(cigar_ops("cigar"), zero, step))
    score = f"{match} * tally.same - {mismatch} * (tally.aligned - tally.same) - {gap_open} * tally.gaps - {gap_extend} * tally.gapped"
    return x.withColumn("score", F.expr(score)).withColumn("nm", F.expr("tally.aligned - tally.same + tally.gapped")).drop("tally")


def _matches(r: Column, q: Column, n: Column) -> Column:
    """Equal letters, N being none, of n letters of ref from r and of seq from q."""
    a, b = F.split(F.substring(F.col("ref"), r + 1, n), ""), F.split(F.substring(F.col("seq"), q + 1, n), "")
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != "N") & (x != "")), lambda same: F.coalesce(same, F.lit(False))))


def projected(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Hits on transcripts (transcript, t_lft, t_rgt: closed, from 0 in the transcript's direction) as genome blocks: with chrom, strand and blocks (lft, rgt) in genome order.

    transcripts: transcript, chrom, strand, exons (lft, rgt, in genome order)."""
    x = hits.join(transcripts, "transcript")
    total = F.aggregate("exons", F.lit(0), lambda a, e: a + e["rgt"] - e["lft"] + 1)
    x = x.withColumn("p", F.when(F.col("strand") == "-", total - 1 - F.col("t_rgt")).otherwise(F.col("t_lft"))).withColumn("s", F.when(F.col("strand") == "-", total - 1 - F.col("t_lft")).otherwise(F.col("t_rgt")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lft:int,rgt:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        size = e["rgt"] - e["lft"] + 1
        a, b = F.greatest(F.col("p") - s["at"], F.lit(0)), F.least(F.col("s") - s["at"], size - 1)
        part = F.array(F.struct((e["lft"] + a).cast("int").alias("lft"), (e["lft"] + b).cast("int").alias("rgt")))
        return F.struct((s["at"] + size).alias("at"), F.when(a <= b, F.concat(s["out"], part)).otherwise(s["out"]).alias("out"))

    return x.withColumn("blocks", F.aggregate("exons", zero, step, lambda s: s["out"])).drop("p", "s", "exons")


def blocks_cigar(blocks: str = "blocks") -> Column:
    """CIGAR of matches and skips of blocks (lft, rgt) in genome order."""
    step = lambda s, b: F.struct(b["rgt"].alias("last"), F.concat(s["out"], F.when(s["last"].isNotNull(), F.concat((b["lft"] - s["last"] - 1).cast("string"), F.lit("N"))).otherwise(""), (b["rgt"] - b["lft"] + 1).cast("string"), F.lit("M")).alias("out"))
    return F.aggregate(F.col(blocks), F.struct(F.lit(None).cast("int").alias("last"), F.lit("").alias("out")), step, lambda s: s["out"])


def molecule_islands(blocks: DataFrame, slack: int = 5) -> DataFrame:
    """molecule, island, lft, rgt, reads, ambiguous: unions of overlapping blocks (molecule, read, part, lft, rgt) of a molecule's reads.

    A molecule is ambiguous if a read leads from an island to another than the next one, or leaves or enters an island by a
    splice more than slack bases inside it.
    """
    placed = overlap_groups(blocks, ["molecule"], "lft", "rgt", ["read", "part"]).withColumnRenamed("session", "island")
    whole = placed.groupBy("molecule", "island").agg(F.min("lft").alias("lft"), F.max("rgt").alias("rgt"), F.countDistinct("read").alias("reads"))
    turn = Window.partitionBy("molecule", "read").orderBy("part")
    step = placed.withColumn("next", F.lead("island").over(turn)).withColumn("next_lft", F.lead("lft").over(turn)).where("next is not null")
    ends = whole.select("molecule", "island", F.col("lft").alias("i_lft"), F.col("rgt").alias("i_rgt"))
    step = step.join(ends.select("molecule", "island", "i_rgt"), ["molecule", "island"]).join(ends.select("molecule", F.col("island").alias("next"), "i_lft"), ["molecule", "next"])
    bad = step.groupBy("molecule").agg(F.max(F.expr(f"next <> island + 1 or i_rgt - rgt > {slack} or next_lft - i_lft > {slack}")).alias("bad"))
    return whole.join(bad, "molecule", "left").select("molecule", "island", "lft", "rgt", "reads", F.coalesce("bad", F.lit(False)).alias("ambiguous"))
