"""Readers of the pipeline's text formats, all as DataFrames over spark.read (gzip by suffix)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.dna import natural_key

#: Barcode and UMI lengths of the library kinds, and whether the tag's strand is flipped.
LIBRARIES = {"V2": (16, 10, False), "V3": (16, 12, False), "V2_5P": (16, 10, True), "V3_5P": (16, 12, True)}


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, n (line number from 0 within the file), value.  A compressed text file is one task, so its lines come in order."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), "value")
    return t.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("id")) - 1).drop("id")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, rec, name, comment, seq, qual of four-line records."""
    x = _lines(spark, path).withColumn("rec", F.floor(F.col("n") / 4)).groupBy("file", "rec").agg(*(F.max(F.when(F.col("n") % 4 == i, F.col("value"))).alias(c) for i, c in ((0, "head"), (1, "seq"), (3, "qual"))))
    head = F.substring(F.col("head"), 2, 1 << 20)
    return x.select("file", "rec", F.substring_index(head, " ", 1).alias("name"), F.when(F.instr(head, " ") > 0, F.expr("substring(head, instr(head, ' ') + 1)")).otherwise("").alias("comment"), "seq", "qual")


def fastq_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """r1, r2: R1 and R2 files of a folder in natural order, paired by rank."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_R[12]_*.fastq*").load(folder).select(F.col("path"))
    k = files.withColumn("read", F.regexp_extract("path", r"_R([12])_\d+\.fastq", 1)).withColumn("rank", F.row_number().over(Window.partitionBy("read").orderBy(natural_key("path"))))
    return k.where("read = '1'").select("rank", F.col("path").alias("r1")).join(k.where("read = '2'").select("rank", F.col("path").alias("r2")), "rank").drop("rank")


def reads_10x(r1: DataFrame, r2: DataFrame, library: str = "V2") -> DataFrame:
    """Reads of one pair of files: barcode, umi (and qualities) of R1, tag of R2; records are paired by number.

    Files of unequal length are an error, raised where the read without a partner is met."""
    b, u, _ = LIBRARIES[library]
    x = r1.select("rec", "name", *(F.substring(c, s, n).alias(o) for c, p in (("seq", ""), ("qual", "q_")) for s, n, o in ((1, b, f"{p}barcode"), (b + 1, u, f"{p}umi"))), F.lit(True).alias("in_r1"))
    both = x.join(r2.select("rec", F.col("seq").alias("tag"), F.col("qual").alias("q_tag"), F.lit(True).alias("in_r2")), "rec", "full_outer")
    whole = F.expr("case when in_r1 and in_r2 then true else raise_error(concat('read ', rec, ' is in one of R1 and R2 only')) end")
    return both.where(whole).drop("rec", "in_r1", "in_r2")


def downsample(reads: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return reads.sample(fraction, seed) if 0 < fraction < 1 else reads


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, comment, seq in file order."""
    x = _lines(spark, path).withColumn("head", F.col("value").startswith(">").cast("int")).withColumn("tid", F.sum("head").over(Window.partitionBy("file").orderBy("n")) - 1)
    g = x.groupBy("file", "tid").agg(F.max(F.when(F.col("head") == 1, F.col("value"))).alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("n", F.trim("value").alias("v"))))), lambda s: s["v"]), "").alias("seq"))
    return g.select("tid", F.regexp_extract("h", r"^>(\S+)", 1).alias("name"), F.trim(F.regexp_extract("h", r"^>\S+(.*)$", 1)).alias("comment"), "seq")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, feature, lft, rgt (0-based, closed), strand and six attributes of exons and codons."""
    c = F.split("value", "\t")
    x = spark.read.text(path).where(~F.col("value").startswith("#")).select(c[0].alias("chrom"), c[2].alias("feature"), (c[3].cast("int") - 1).alias("lft"), (c[4].cast("int") - 1).alias("rgt"), c[6].alias("strand"), c[8].alias("attrs"))
    keys = ("gene_id", "transcript_id", "gene_name", "gene_biotype", "transcript_name", "transcript_biotype")
    return x.where(F.col("feature").isin("exon", "start_codon", "stop_codon")).select("chrom", "feature", "lft", "rgt", "strand", *(F.nullif(F.regexp_extract("attrs", rf'(?:^|[; ]){k} "([^"]*)"', 1), F.lit("")).alias(k) for k in keys))


def transcripts(features: DataFrame) -> DataFrame:
    """One row per transcript: extent, exons in order, coding range (null without codons)."""
    exon, codon = F.col("feature") == "exon", F.col("feature") != "exon"
    return features.groupBy("chrom", "gene_id", "transcript_id", "strand").agg(
        F.min(F.when(exon, F.col("lft"))).alias("lft"), F.max(F.when(exon, F.col("rgt"))).alias("rgt"), F.array_sort(F.collect_list(F.when(exon, F.struct("lft", "rgt")))).alias("exons"),
        F.min(F.when(codon, F.col("lft"))).alias("coding_start"), F.max(F.when(codon, F.col("rgt"))).alias("coding_end"),
    )


def genes(tx: DataFrame) -> DataFrame:
    return tx.groupBy("chrom", "gene_id", "strand").agg(F.min("lft").alias("lft"), F.max("rgt").alias("rgt"), F.count("*").alias("transcripts"))


def transcript_filter(features: DataFrame, retained: bool = False, nonsense: bool = False) -> DataFrame:
    drop = [] if retained else ["retained_intron"]
    drop += [] if nonsense else ["nonsense_mediated_decay", "non_stop_decay"]
    return features.where(~F.coalesce("transcript_biotype", F.lit("")).isin(drop) if drop else F.lit(True))


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of SAM text: core columns (pos 0-based) and the tags CB, UB, XG, XS, RA, RE, NM."""
    c = F.split("value", "\t")
    x = spark.read.text(path).where(~F.col("value").startswith("@"))
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:\w:([^\t]*)", 1), F.lit("")).alias(t)
    return x.select(c[0].alias("name"), c[1].cast("int").alias("flag"), c[2].alias("chrom"), (c[3].cast("int") - 1).alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), c[9].alias("seq"), c[10].alias("qual"), *map(tag, ("CB", "UB", "XG", "XS", "RA", "RE", "NM")))


def merged_alignments(parts: list[DataFrame]) -> DataFrame:
    """Union of alignments with filenum, in order of contig, position and strand, unmapped last."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [p.withColumn("filenum", F.lit(i)) for i, p in enumerate(parts)])
    return every.orderBy(F.when(F.col("chrom") != "*", F.col("chrom")).asc_nulls_last(), "pos", F.col("flag").bitwiseAND(16))


def vcf(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """chrom, pos (0-based), ref, alt, source of passing single-allele substitutions."""
    from functools import reduce

    c = F.split("value", "\t")
    one = lambda p, n: spark.read.text(p).where(~F.col("value").startswith("#")).where(c[6] == "PASS").select(c[0].alias("chrom"), (c[1].cast("int") - 1).alias("pos"), c[3].alias("ref"), c[4].alias("alt"), F.lit(n).alias("source"))
    return reduce(DataFrame.unionByName, [one(p, n) for p, n in zip(paths, names, strict=True)]).where("length(ref) = 1 and length(alt) = 1 and alt rlike '^[ACGT]$'")


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """barcode, cnt, idx of the first line of each barcode without N, in file order."""
    c = F.split("value", "[\t,]")
    x = _lines(spark, path).select("n", c[0].alias("barcode"), F.coalesce(F.get(c, 1).cast("bigint"), F.lit(0)).alias("cnt")).where("barcode rlike '^[ACGT]+$'")
    first = x.groupBy("barcode").agg(F.min(F.struct("n", "cnt")).alias("f"))
    return first.select("barcode", F.col("f.cnt").alias("cnt"), (F.row_number().over(Window.orderBy("f.n")) - 1).alias("idx"))


def tsv(spark: SparkSession, path: str | list[str], required: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Tab-separated with a header; raises if a required column is missing.  (SNV lists, gene groups, barcodes, totals, annotation tables.)"""
    x = spark.read.options(sep="\t", header="true", **options).csv(path)
    missing = [c for c in required if c not in x.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return x


def snv_list(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, ("chrom", "pos", "ref", "alt", "strand")).withColumn("pos", F.col("pos").cast("int"))


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("n").alias("tid"), F.split("value", "\t")[0].alias("name"), F.split("value", "\t")[1].cast("int").alias("length"))


def mixture_map(spark: SparkSession, path: str) -> DataFrame:
    """cell, filenum, barcode, doublet from lines `cell \\t file:barcode[,file:barcode]` after a header."""
    x = tsv(spark, path).toDF("cell", "list").withColumn("item", F.explode(F.split("list", ",")))
    return x.select("cell", F.split("item", ":")[0].cast("int").alias("filenum"), F.split("item", ":")[1].alias("barcode"), (F.size(F.split("list", ",")) > 1).alias("doublet"))


def bed(spark: SparkSession, path: str, flank: int = 0) -> DataFrame:
    """chrom, lft, rgt (0-based, closed) with a flank on both sides, not below 0."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").rlike(r"^[^\t]+\t\d+\t\d+")).select(c[0].alias("chrom"), F.greatest(c[1].cast("int") - flank, F.lit(0)).alias("lft"), (c[2].cast("int") - 1 + flank).alias("rgt"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """row, col (from 0), value of a coordinate matrix."""
    c = F.split(F.trim("value"), r"\s+")
    x = _lines(spark, path).where(~F.col("value").startswith("%"))
    head = F.min("n").over(Window.partitionBy("file"))
    return x.withColumn("head", head).where("n > head").select((c[0].cast("bigint") - 1).alias("row"), (c[1].cast("bigint") - 1).alias("col"), c[2].cast("double").alias("value"))


def compact(matrix: DataFrame, columns: DataFrame) -> DataFrame:
    """row, col, value of the given columns (col), rows and columns numbered anew without holes."""
    x = matrix.join(columns, "col", "left_semi")
    rows = x.select("row").distinct().withColumn("r", F.row_number().over(Window.orderBy("row")) - 1)
    cols = x.select("col").distinct().withColumn("c", F.row_number().over(Window.orderBy("col")) - 1)
    return x.join(rows, "row").join(cols, "col").select(F.col("r").alias("row"), F.col("c").alias("col"), "value")


def pileup_targets(spark: SparkSession, path: str, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, pos, alt) of a list by place of its columns (1st contig, 2nd position, 4th base, after a header), and the contigs that contigs (tid, name) doesn't have."""
    c = F.split("value", "\t")
    x = _lines(spark, path).where("n > 0 and value <> '' and not startswith(value, '\t')").select(c[0].alias("name"), c[1].cast("int").alias("pos"), F.substring(c[3], 1, 1).alias("alt"))
    return x.join(contigs.select("name", "tid"), "name").select("tid", "pos", "alt"), x.join(contigs, "name", "left_anti").select("name").distinct()


def accuracy_list(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt of the first four columns after a header, with the line as it is."""
    c = F.split("value", "\t")
    return _lines(spark, path).where("n > 0 and value <> ''").select(c[0].alias("chrom"), c[1].cast("int").alias("pos"), c[2].alias("ref"), c[3].alias("alt"), F.col("value").alias("line"))


def with_totals(files: DataFrame, totals: DataFrame) -> DataFrame:
    """FASTQ files (dir, file, ...) with their reads from a totals table (dir, file, total), 0 for files that it doesn't have."""
    t = totals.select("dir", "file", F.col("total").cast("bigint").alias("total"))
    return files.join(t, ["dir", "file"], "left").withColumn("total", F.coalesce("total", F.lit(0)))


def accuracy_results(spark: SparkSession, folder: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(results, snvs) of a folder: tables <prefix>_*.txt.gz with the file each row came from, and that whose name ends in _snvs."""
    x = tsv(spark, folder, pathGlobFilter=f"{prefix}_*.txt.gz").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    snvs = F.col("file").endswith("_snvs.txt.gz")
    return x.where(~snvs), x.where(snvs)


def index_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of an index folder with their exons (lft, rgt) as an array again, in genome order."""
    x = spark.read.parquet(f"{path}/transcripts")
    ends = (F.transform(F.split(f"exon_{c}", ","), lambda v: v.cast("int")) for c in ("lft", "rgt"))
    return x.withColumn("exons", F.transform(F.arrays_zip(*(e.alias(c) for e, c in zip(ends, ("lft", "rgt"), strict=True))), lambda e: F.struct(e["lft"].alias("lft"), e["rgt"].alias("rgt")))).drop("exon_lft", "exon_rgt")


def sample_data(spark: SparkSession, path: str, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNVs and calls (snv, barcode, ...) of a stored sample, calls of the given barcodes only, if any are."""
    calls = spark.read.parquet(f"{path}/calls")
    return spark.read.parquet(f"{path}/snvs"), calls if keep is None else calls.join(keep.select("barcode").distinct(), "barcode", "left_semi")


def length_filter(tx: DataFrame, least: int = 100) -> DataFrame:
    """Transcripts (exons) of at least so many bases."""
    return tx.where(F.aggregate("exons", F.lit(0), lambda a, e: a + e["rgt"] - e["lft"] + 1) >= least)
