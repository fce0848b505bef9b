"""Molecules: UMI graphs, multi-gene UMIs, counters by gene, barcode and group, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def barcode_totals(reads: DataFrame) -> DataFrame:
    """dir, file, total, correct, ambig with subtotals (nulls) from reads (dir, file, status 0 hit, 1 ambiguous, 2 miss)."""
    return reads.rollup("dir", "file").agg(F.count("*").alias("total"), F.count_if(F.col("status") == 0).alias("correct"), F.count_if(F.col("status") == 1).alias("ambig"))


def umi_nodes(tags: DataFrame) -> DataFrame:
    return tags.groupBy("barcode", "gene", "umi").agg(F.count("*").alias("cnt"))


def _graph(barcode: np.ndarray, gene: np.ndarray, umi: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """umi_to of rows sorted by (barcode, gene, umi), whole groups, all groups at once."""
    n = len(umi)
    new = np.ones(n, bool)
    new[1:] = (barcode[1:] != barcode[:-1]) | (gene[1:] != gene[:-1])
    bits = max(2, int(umi.max()).bit_length() + 1) // 2 * 2
    group = (np.cumsum(new) - 1) << (bits + 1)
    key = group | umi
    ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, bits, 2):
        for x in (1, 2, 3):
            other = key ^ (x << i)
            at = np.minimum(np.searchsorted(key, other), n - 1)
            u = np.flatnonzero((key[at] == other) & (other > key))
            low, high = np.minimum(cnt[u], cnt[at[u]]), np.maximum(cnt[u], cnt[at[u]])
            joined = (high == 1) | (high >= 2 * low - 1)
            ends.append((u[joined], at[u[joined]]))
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        least = label.copy()
        np.minimum.at(least, label[u], low)
        np.minimum.at(least, label[v], low)
        least = least[least]
        if (least == label).all():
            break
        label = least
    order = np.lexsort((umi, -cnt, label))
    best = np.full(n, -1)
    first = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1]))) if n else order
    best[label[order[first]]] = umi[order[first]]
    return best[label]


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (barcode, gene, umi) with umi_to; only a group that goes on in the next batch waits for it."""
    held: list[np.ndarray] | None = None
    names = ["barcode", "gene", "umi", "cnt", "umi_to"]
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(4)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 if (now[0][0], now[1][0]) != (now[0][-1], now[1][-1]) else 0
        held = [x[last:] for x in now]
        if last:
            done = [x[:last] for x in now]
            yield pa.RecordBatch.from_arrays([*map(pa.array, done), pa.array(_graph(*done))], names)
    if held is not None and len(held[0]):
        yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array(_graph(*held))], names)


def correct_umis(nodes: DataFrame) -> DataFrame:
    """barcode, gene, umi, cnt, umi_to: each component of the UMI graph of a (barcode, gene) takes its most frequent UMI, of equal ones the least.

    UMIs at one substitution are joined if both have one read, or one has more and at least 2 c - 1 of the other's c.  A
    group holds the distinct UMIs of a gene in a cell, 4 ** length of them at most; groups are sorted within their
    partitions and solved many at a time.
    """
    whole = nodes.select(*(F.col(c).cast("bigint").alias(c) for c in ("barcode", "gene", "umi", "cnt"))).repartition("barcode", "gene").sortWithinPartitions("barcode", "gene", "umi")
    return whole.mapInArrow(_graphs, "barcode bigint, gene bigint, umi bigint, cnt bigint, umi_to bigint")


def apply_umi_map(tags: DataFrame, umi_map: DataFrame) -> DataFrame:
    """tags with umi replaced where the map has another (umi_from kept)."""
    m = umi_map.where("umi <> umi_to").select("barcode", "gene", "umi", "umi_to")
    return tags.join(m, ["barcode", "gene", "umi"], "left").withColumn("umi_from", F.col("umi")).withColumn("umi", F.coalesce("umi_to", "umi")).drop("umi_to")


def multi_gene_umis(nodes: DataFrame) -> DataFrame:
    """Bad (barcode, gene, umi): those of UMIs in two genes or more but for a gene with the unique maximum of reads."""
    w = Window.partitionBy("barcode", "umi")
    x = nodes.withColumn("genes", F.count("*").over(w)).withColumn("top", F.max("cnt").over(w))
    x = x.withColumn("tops", F.sum(F.when(F.col("cnt") == F.col("top"), 1).otherwise(0)).over(w))
    return x.where("genes > 1 and (cnt < top or tops > 1)").select("barcode", "gene", "umi", "cnt")


def molecules(tags: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """barcode, gene: molecules, reads, pcr_dups (reads less distinct positions) of exonic molecules; intronic, intron_reads and
    intron_pcr_dups of those with an intronic read; discarded: reads of bad UMIs (barcode, gene, umi)."""
    if bad is not None:
        tags = tags.join(bad.select("barcode", "gene", "umi", F.lit(True).alias("bad")), ["barcode", "gene", "umi"], "left")
    else:
        tags = tags.withColumn("bad", F.lit(None).cast("boolean"))
    each = tags.groupBy("barcode", "gene", "umi").agg(F.bool_or("intronic").alias("intronic"), F.count("*").alias("reads"), F.countDistinct("pos").alias("places"), F.max("bad").alias("bad"))
    ok, intron = F.col("bad").isNull(), F.coalesce(F.col("intronic"), F.lit(False))
    total = lambda test, value: F.coalesce(F.sum(F.when(test, F.expr(value))), F.lit(0))
    return each.groupBy("barcode", "gene").agg(
        F.count_if(ok & ~intron).alias("molecules"), total(ok & ~intron, "reads").alias("reads"), total(ok & ~intron, "reads - places").alias("pcr_dups"),
        F.count_if(ok & intron).alias("intronic"), total(ok & intron, "reads").alias("intron_reads"), total(ok & intron, "reads - places").alias("intron_pcr_dups"),
        total(~ok, "reads").alias("discarded"),
    )


def barcode_rates(gene_counts: DataFrame) -> DataFrame:
    """barcode and eight counters: molecules, genes (with an exonic molecule), pcr_dups, reads, those of introns, discarded_reads."""
    return gene_counts.groupBy("barcode").agg(
        F.sum("molecules").alias("molecules"), F.count_if(F.col("molecules") > 0).alias("genes"), F.sum("pcr_dups").alias("pcr_dups"), F.sum("reads").alias("reads"),
        F.sum("intronic").alias("intron_molecules"), F.sum("intron_pcr_dups").alias("intron_pcr_dups"), F.sum("intron_reads").alias("intron_reads"), F.sum("discarded").alias("discarded_reads"),
    )


def group_counts(gene_counts: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Exonic molecules by barcode in columns group_<name>; genes may be in many groups, unknown genes are skipped."""
    x = gene_counts.join(groups, "gene").groupBy("barcode").pivot("grp", names).agg(F.sum("molecules"))
    return x.select("barcode", *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(f"group_{n}") for n in names))


def unknown_genes(groups: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of a gene-group table whose gene is not among genes (gene)."""
    return groups.join(genes.select("gene").distinct(), "gene", "left_anti")


def duplicate_summary(gene_counts: DataFrame) -> DataFrame:
    """Reads, molecules, PCR duplicates and discarded reads in all, and six percentages: UMI and PCR duplicates of cDNA, introns and both (null without reads)."""
    names = ("molecules", "reads", "pcr_dups", "intronic", "intron_reads", "intron_pcr_dups", "discarded")
    s = gene_counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    umi = lambda m, r: F.expr(f"100d - 100d * ({m}) / nullif({r}, 0)")
    pcr = lambda d, r: F.expr(f"100d * ({d}) / nullif({r}, 0)")
    return s.select(
        F.expr("reads + intron_reads").alias("all_reads"), F.expr("molecules + intronic").alias("all_molecules"), F.expr("pcr_dups + intron_pcr_dups").alias("all_pcr_dups"), "discarded",
        umi("molecules", "reads").alias("cdna_umi_percent"), pcr("pcr_dups", "reads").alias("cdna_pcr_percent"), umi("intronic", "intron_reads").alias("intron_umi_percent"), pcr("intron_pcr_dups", "intron_reads").alias("intron_pcr_percent"),
        umi("molecules + intronic", "reads + intron_reads").alias("total_umi_percent"), pcr("pcr_dups + intron_pcr_dups", "reads + intron_reads").alias("total_pcr_percent"),
    )


def flag_duplicates(reads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """dup: all but the first read of a key."""
    return reads.withColumn("dup", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def classify_reads(hits: DataFrame, band: int = 3) -> DataFrame:
    """read, result from hits (read, kind, gene, score): kinds CDNA, INTRON, INTERGENIC, AMBIGUOUS, ANTISENSE.

    Hits within the band of the best score pass.  First match wins: an intron and a cDNA hit of one gene are ambiguous;
    more than one target, or intergenic with antisense, is multi-mapped; without targets ambiguous, then antisense hits
    decide; one target is intronic, cDNA or intergenic; else ambiguous.
    """
    best = hits.withColumn("best", F.max("score").over(Window.partitionBy("read"))).where(F.col("score") >= F.col("best") - band)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    x = best.groupBy("read").agg(
        F.count_distinct(F.when(F.col("kind") == "CDNA", F.col("gene"))).alias("c"), n("INTRON").alias("i"), n("INTERGENIC").alias("x"), n("AMBIGUOUS").alias("m"), n("ANTISENSE").alias("s"),
        F.max(F.when(F.col("kind") == "CDNA", F.col("gene"))).alias("cg"), F.max(F.when(F.col("kind") == "INTRON", F.col("gene"))).alias("ig"),
    ).withColumn("g", F.expr("c + i + x"))
    return x.select("read", F.expr("""case when i = 1 and c = 1 and cg = ig then 'AMBIGUOUS' when g > 1 or (x > 0 and s > 0) then 'MULTIMAPPED' when g = 0 and m > 0 then 'AMBIGUOUS'
      when g = 0 and s > 0 then 'ANTISENSE' when g = 1 and i = 1 then 'INTRONIC' when g = 1 and c = 1 then 'CDNA' when g = 1 then 'INTERGENIC' else 'AMBIGUOUS' end""").alias("result"))
