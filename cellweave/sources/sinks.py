"""Writers: tables as Parquet or gzip TSV, matrices, VCF and FASTQ as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").options(sep="\t", header="true", compression="gzip").csv(path)


def parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def barcode_counts(counts: DataFrame, path: str) -> None:
    """Only barcodes that were seen."""
    tsv(counts.where("cnt > 0"), path)


def _text(head: list[str], body: DataFrame, order: list[Column | str], path: str) -> None:
    """One text folder: header lines, then the column `line` in order."""
    spark = body.sparkSession
    top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "n bigint, line string")
    rows = body.orderBy(*order).select(F.monotonically_increasing_id().alias("n"), "line")
    top.unionByName(rows).orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(path)


def matrix_market(matrix: DataFrame, path: str, rows: int, cols: int) -> None:
    """Coordinate format of row, col (from 0), value; zeros are not listed."""
    x = matrix.where("value <> 0")
    line = F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("value").cast("bigint").cast("string"))
    _text(["%%MatrixMarket matrix coordinate integer general", f"{rows} {cols} {x.count()}"], x.withColumn("line", line), ["col", "row"], path)


def vcf(snvs: DataFrame, path: str) -> None:
    """Minimal VCF 4.2 of chrom, pos (0-based), ref, alt."""
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."))
    _text(["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"], snvs.withColumn("line", line), ["chrom", "pos", "alt"], path)


def fastq(reads: DataFrame, path: str, length: int | None = None, limit: int | None = None) -> None:
    """Four-line records of name, seq, qual, cut to a length; limit: at most so many reads."""
    r = reads.limit(limit) if limit is not None else reads
    cut = (lambda c: F.substring(c, 1, length)) if length else F.col
    r.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), cut("seq"), F.lit("+"), cut("qual")).alias("line")).write.mode("overwrite").option("compression", "gzip").text(path)


def folder_10x(matrix: DataFrame, genes: DataFrame, barcodes: DataFrame, path: str) -> None:
    """genes.tsv (gid, gene_id, gene_name), barcodes.tsv (bid, barcode), matrix.mtx (row gene, col barcode)."""
    genes.orderBy("gid").select(F.concat_ws("\t", "gene_id", "gene_name")).coalesce(1).write.mode("overwrite").text(f"{path}/genes.tsv")
    barcodes.orderBy("bid").select("barcode").coalesce(1).write.mode("overwrite").text(f"{path}/barcodes.tsv")
    matrix_market(matrix, f"{path}/matrix.mtx", genes.count(), barcodes.count())


def table(df: DataFrame, path: str, *order: str) -> None:
    """A gzip TSV in order (of the columns given; range-partitioned, so that its files follow each other)."""
    tsv(df.orderBy(*order) if order else df, path)


def barcode_totals(totals: DataFrame, path: str) -> None:
    """dir, file, total, correct, ambig, and the grand total (dir and file null) last."""
    table(totals.where("file is not null or dir is null"), path, "dir", "file")


def alignments(reads: DataFrame, path: str, *by: str) -> None:
    """Alignments as Parquet, by contig, sorted within files by place and strand; multimap: other places (chrom, strand, pos, cigar, nm) as one text."""
    x = reads
    if "places" in reads.columns:
        one = lambda p: F.concat_ws(",", p["chrom"], F.concat(p["strand"], (p["pos"] + 1).cast("string")), p["cigar"], p["nm"].cast("string"))
        x = reads.withColumn("XA", F.array_join(F.transform("places", one), ";")).drop("places")
    by = by or ("chrom",)
    x.repartition(*by).sortWithinPartitions(*by, "pos").write.mode("overwrite").partitionBy(*by).parquet(path)


def quant_summary(path: str, rates: DataFrame, gene_counts: DataFrame, groups: DataFrame | None = None) -> None:
    """barcode_rates (most molecules first), exonic and intronic counts by barcode and gene (zeros aren't listed), and group counts, as Parquet tables of a folder."""
    rates.orderBy(F.desc("molecules"), "barcode").write.mode("overwrite").parquet(f"{path}/barcode_rates")
    for name, column in (("exonic", "molecules"), ("intronic", "intronic")):
        gene_counts.where(F.col(column) > 0).select("barcode", "gene", F.col(column).alias("count")).write.mode("overwrite").parquet(f"{path}/{name}")
    if groups is not None:
        groups.write.mode("overwrite").parquet(f"{path}/groups")


def barcode_matrices(cell_counts: DataFrame, coverage: DataFrame, path: str) -> None:
    """Counts of cells (tid, pos, barcode, base, plus, minus) partitioned by base, and coverage."""
    cell_counts.write.mode("overwrite").partitionBy("base").parquet(f"{path}/bases")
    coverage.write.mode("overwrite").parquet(f"{path}/coverage")


def snv_counts(path: str, reads: DataFrame, sets: DataFrame, pairs: DataFrame, histogram: DataFrame, barcodes: DataFrame) -> None:
    """Reads of SNVs, sets with their ids, edges (pair tables), base histogram and most bases of barcodes, a TSV each."""
    for name, df, order in (("reads", reads, ("molecule", "snv")), ("map", sets, ("set_id",)), ("edges", pairs, ("s1", "s2")), ("base_counts", histogram, ("reads", "pcr_dups", "bases")), ("barcode_bases", barcodes, ("barcode",))):
        table(df, f"{path}_{name}.txt.gz", *order)


def accuracy(counts: DataFrame, aligner: str, path: str, keys: tuple[str, ...] = ("chrom", "pos")) -> None:
    """Counts with their columns (but for keys) prefixed by the aligner."""
    table(counts.select(*keys, *(F.col(f"`{c}`").alias(f"{aligner}_{c}") for c in counts.columns if c not in keys)), path, *keys)


def index_tables(path: str, genes: DataFrame, transcripts: DataFrame, lengths: DataFrame) -> None:
    """genes, transcripts (exons as comma lists) and contig lengths as Parquet and TSV."""
    genes.write.mode("overwrite").parquet(f"{path}/genes")
    lists = (F.array_join(F.transform("exons", lambda e: e[c].cast("string")), ",").alias(f"exon_{c}") for c in ("lft", "rgt"))  # noqa: B023
    transcripts.select(*(c for c in transcripts.columns if c != "exons"), *lists).write.mode("overwrite").parquet(f"{path}/transcripts")
    table(lengths, f"{path}/lengths.txt.gz", "tid")


def fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """>name and lines of a width of name, seq."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("line")).write.mode("overwrite").text(path)


def annotated(path: str, snvs: DataFrame, passed: str, filtering: DataFrame) -> None:
    """The store of all SNVs, a list of those whose column passed is true, and counts of reasons."""
    snvs.write.mode("overwrite").parquet(f"{path}/snvs")
    table(snvs.where(F.col(passed)), f"{path}_passed_snvs.txt.gz", "chrom", "pos")
    table(filtering, f"{path}_filtering.txt", "reason")


def dense_csv(matrix: DataFrame, names: list[str], path: str) -> None:
    """One line for each row of a matrix (row, col, value), one column for each name (a list of the caller's, col numbers its place), zeros filled in."""
    wide = matrix.groupBy("row").pivot("col", list(range(len(names)))).agg(F.sum("value"))
    wide.select("row", *(F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(n) for i, n in enumerate(names))).orderBy("row").write.mode("overwrite").option("header", "true").csv(path)


def cells(path: str, barcodes: DataFrame, genes: DataFrame, spliced: DataFrame, unspliced: DataFrame) -> None:
    """Passed barcodes as a TSV; genes, cells and both count matrices as Parquet."""
    table(barcodes.select("barcode"), f"{path}_passed_barcodes.txt.gz", "barcode")
    for name, df in (("cells", barcodes), ("genes", genes), ("spliced", spliced), ("unspliced", unspliced)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
