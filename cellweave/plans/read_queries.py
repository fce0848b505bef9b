"""Registered queries of alignments, histograms, mixtures and annotations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import annotate, pileup, quant, reads, snv

from .queries import _MAP, _POS, _RATES, VIEWS, register, view

S = "CAST({} AS VARCHAR(9))".format
_KIND = "CASE l_orderkey % 8 WHEN 0 THEN 'CDNA' WHEN 1 THEN 'CDNA' WHEN 2 THEN 'INTRONIC' WHEN 3 THEN 'INTERGENIC' WHEN 4 THEN 'AMBIGUOUS' WHEN 5 THEN 'ANTISENSE' WHEN 6 THEN 'MULTIMAPPED' END"
_KS = "(SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) ks"
VIEWS.update({
    "sam": ("orders", f"SELECT o_orderkey AS id, concat('Brand#', {S('1 + o_orderkey % 25')}) AS contig, o_orderkey * 13 % 10000 AS lft, o_orderkey * 13 % 10000 + 20 + (o_orderkey * 7 + o_custkey) % 80 AS rgt, o_custkey % 2 = 0 AS reverse, CASE WHEN (1 + o_custkey % 7) = 7 THEN 10 WHEN (1 + o_custkey % 7) = 6 THEN 30 ELSE 255 END AS mapq, CASE (o_orderkey * 7 + o_custkey) % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'N' WHEN 2 THEN 'A' ELSE '?' END AS RA, concat('g', {S('(o_orderkey * 7 + o_custkey) % 300')}) AS XG, CASE WHEN (o_custkey % 100) % 11 > 0 THEN concat('B', {S('(o_custkey % 100)')}, '-1') END AS CB, CASE WHEN (o_custkey % 100) % 7 > 0 THEN 'ACGT' END AS UB, CASE (o_orderkey * 7 + o_custkey) % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'N' WHEN 2 THEN 'I' END AS RE, o_orderkey % 3 % 2 AS MM, CASE (o_orderkey * 7 + o_custkey) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'g1;g2' ELSE concat('g', {S('(o_orderkey * 7 + o_custkey) % 300')}) END AS GX, o_custkey % 5 = 0 AS dup FROM orders"),
    "gene_model": ("part", f"SELECT p_brand AS contig, p_partkey AS gid, concat('g', {S('p_partkey')}) AS gene_id, p_partkey * 37 % 10000 AS g_lft, p_partkey * 37 % 10000 + p_size * 10 AS g_rgt, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part"),
    "introns": ("part", f"SELECT p_partkey AS gid, p_partkey * 37 % 10000 + k * 60 + 30 AS i_lft, p_partkey * 37 % 10000 + k * 60 + 50 AS i_rgt FROM part CROSS JOIN {_KS} WHERE p_size * 10 > k * 60 + 55"),
    "exons": ("part", f"SELECT p_partkey AS transcript, p_partkey * 37 % 10000 + k * 60 AS lft, p_partkey * 37 % 10000 + k * 60 + 30 + p_size % 20 AS rgt, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part CROSS JOIN {_KS}"),
    "blocks": ("orders", f"SELECT o_custkey AS molecule, o_orderkey AS read, k AS part, CAST(o_custkey % 50 * 10 + k * 200 + o_orderkey % 4 AS BIGINT) AS lft, CAST(o_custkey % 50 * 10 + k * 200 + 40 + o_orderkey % 9 AS BIGINT) AS rgt FROM orders CROSS JOIN {_KS} WHERE (o_orderkey + k) % 11 > 0"),
    "passed": ("supplier", f"SELECT concat('B', {S('s_suppkey')}) AS barcode, s_suppkey AS bid FROM supplier WHERE s_acctbal > 0"),
    "results": ("lineitem", f"SELECT l_suppkey AS barcode, l_linenumber < 7 AS barcode_ok, l_partkey % 9 > 0 AS umi_ok, l_partkey % 8 > 0 AS tag_ok, {_KIND} AS kind, l_quantity > 45 AS corrected FROM lineitem"),
    "align_hits": ("lineitem", "SELECT l_orderkey AS read, l_returnflag = 'R' AS antisense, l_partkey % 3 AS gene, 45 + CAST(l_quantity AS BIGINT) % 6 AS score, l_linenumber AS transcript FROM lineitem"),
    "collapsed": ("lineitem", f"SELECT l_suppkey AS barcode, l_orderkey * 8 + l_linenumber AS molecule, l_partkey % 3 AS f1, l_suppkey % 3 AS f2, l_orderkey % 3 AS f3, concat({S('l_partkey % 3')}, ',', {S('l_partkey % 3 + 50')}, ',50M;', {S('l_suppkey % 3')}, ',', {S('l_suppkey % 3 + 50')}, ',20M9N30M;', {S('l_orderkey % 3')}, ',', {S('l_orderkey % 3 + 50')}, ',50M') AS xr, 1 + l_partkey % 9 AS reads, l_orderkey % 1300 AS bases, l_partkey % 13 = 0 AS ambiguous, l_suppkey % 17 = 0 AS lost FROM lineitem"),
    "mixed": ("lineitem", "SELECT l_linenumber % 2 AS filenum, l_suppkey AS barcode, l_orderkey AS o, l_partkey AS p FROM lineitem"),
    "mix_cells": ("supplier", "SELECT CAST(s_suppkey % 40 AS BIGINT) AS cell, s_nationkey % 2 AS filenum, s_suppkey AS barcode FROM supplier"),
    "snv_list": ("part", "SELECT p_partkey AS snv, p_partkey % 5 AS tid, p_partkey % 210 AS pos, CASE WHEN p_size > 25 THEN '+' ELSE '-' END AS strand, (p_partkey % 210) % 4 AS ref, (p_partkey + p_size) % 4 AS alt FROM part"),
    "sites": ("part", "SELECT p_partkey AS snv, p_brand AS chrom, p_partkey * 37 % 10000 AS pos, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + (p_partkey + 1 + p_size % 3) % 4 AS INT), 1) AS alt, p_size % 5 > 0 AS purity_ok, p_size % 3 > 0 AS strand_ok FROM part"),
    "calls": ("part", "SELECT p_brand AS chrom, p_partkey * 37 % 10000 AS pos, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + (p_partkey + 1 + k) % 4 AS INT), 1) AS alt, CASE k WHEN 0 THEN 'germline' WHEN 1 THEN 'somatic' ELSE 'raw' END AS source, p_type AS note FROM part CROSS JOIN " + _KS + " WHERE (p_partkey + k) % 2 = 0"),
    "rmsk": ("part", "SELECT p_brand AS chrom, p_partkey * 91 % 10000 AS lft, p_partkey * 91 % 10000 + p_size * 4 AS rgt, p_name AS rep_name, p_type AS rep_class, p_brand AS rep_family, CASE WHEN p_size > 25 THEN '+' ELSE '-' END AS rep_strand FROM part"),
})


@register("counted_reads", "SELECT id, gid FROM sam JOIN gene_model ON XG = gene_id WHERE RA IN ('E', 'N') AND mapq = 255", ("sam", "gene_model"))
def counted_reads(spark, d):
    return reads.counted_reads(view(spark, d, "sam"), view(spark, d, "gene_model")).select("id", "gid")


@register("cellranger_reads", """CTE good AS (SELECT *, CASE WHEN reverse THEN '-' ELSE '+' END AS XS FROM sam WHERE mapq = 255 AND CB IS NOT NULL AND UB IS NOT NULL AND NOT coalesce(RE = 'E' AND MM = 1, false)),
 inner_ AS (SELECT id, XS, min(gid) AS gid FROM good g JOIN gene_model m ON g.contig = m.contig AND lft <= g_rgt AND g_lft <= rgt AND m.strand = g.XS WHERE RE = 'N' OR (RE IS NULL AND GX IS NULL) GROUP BY id, XS HAVING count(*) = 1)
 SELECT id, XS AS xs, gid FROM good JOIN gene_model ON GX = gene_id WHERE (RE = 'E' OR RE IS NULL) AND NOT contains(GX, ';') UNION ALL SELECT id, XS, gid FROM inner_""", ("sam", "gene_model"))  # fmt: skip
def cellranger_reads(spark, d):
    return reads.cellranger_reads(view(spark, d, "sam"), view(spark, d, "gene_model")).select("id", F.col("XS").alias("xs"), "gid")


@register("genome_reads", "SELECT id, mapq FROM sam WHERE mapq >= 20 AND NOT dup", ("sam",))
def genome_reads(spark, d):
    return reads.genome_reads(view(spark, d, "sam"), 20, duplicates=False).select("id", "mapq")


@register("passed_barcodes", "SELECT bid, count(*) AS n FROM sam JOIN passed ON split_part(CB, '-', 1) = barcode GROUP BY bid", ("sam", "passed"))
def passed_barcodes(spark, d):
    return reads.by_barcode(view(spark, d, "sam"), view(spark, d, "passed")).groupBy("bid").agg(F.count("*").alias("n"))


_BASES = """pairs AS MATERIALIZED (SELECT id, gid, strand, CASE WHEN reverse THEN '-' ELSE '+' END AS xs, lft, rgt, least(rgt, g_rgt) - greatest(lft, g_lft) + 1 AS overlap FROM sam s JOIN gene_model g ON s.contig = g.contig AND lft <= g_rgt AND g_lft <= rgt),
 inside AS (SELECT id, p.gid, sum(least(rgt, i_rgt) - greatest(lft, i_lft) + 1) FILTER (i_lft < rgt AND lft <= i_rgt) AS intronic FROM pairs p JOIN introns i ON p.gid = i.gid GROUP BY id, p.gid),
 gene_bases AS MATERIALIZED (SELECT id, gid, strand, xs, CAST(overlap - coalesce(intronic, 0) AS BIGINT) AS exonic, CAST(coalesce(intronic, 0) AS BIGINT) AS intronic, rgt - lft + 1 - overlap AS intergenic FROM pairs LEFT JOIN inside USING (id, gid))"""


def _spans(spark, d):
    x = view(spark, d, "sam").select("id", "contig", "lft", "rgt", F.expr("rgt - lft + 1").alias("bases"), F.expr("if(reverse, '-', '+')").alias("xs"))
    return x, view(spark, d, "gene_model"), view(spark, d, "introns")


@register("gene_bases", f"CTE {_BASES} SELECT * FROM gene_bases", ("sam", "gene_model", "introns"))
def gene_bases(spark, d):
    return reads.gene_bases(*_spans(spark, d))


@register("span_classes", f"""CTE {_BASES}, near AS (SELECT *, strand = xs AS same FROM gene_bases QUALIFY max(exonic) OVER (PARTITION BY id, strand = xs) - exonic < 5),
 per AS (SELECT id, count(*) FILTER (same) AS ovc, count(*) FILTER (NOT same) AS ova, arg_max(gid, exonic) FILTER (same) AS mg, max(exonic) FILTER (same) AS me, arg_max(intronic, exonic) FILTER (same) AS mi, arg_max(gid, exonic) FILTER (NOT same) AS ag FROM near GROUP BY id),
 k AS (SELECT s.id, ova, mg, ag, CASE WHEN ovc IS NULL THEN 'INTERGENIC' WHEN ovc > 1 THEN 'AMBIGUOUS' WHEN ovc = 0 THEN 'ANTISENSE' WHEN me >= 25 AND mi < 5 THEN 'CDNA' WHEN mi >= 5 THEN 'INTRON' ELSE 'INTERGENIC' END AS kind FROM sam s LEFT JOIN per ON per.id = s.id)
 SELECT id, kind, CASE WHEN kind IN ('CDNA', 'INTRON') THEN mg WHEN kind = 'ANTISENSE' AND ova = 1 THEN ag END AS gid FROM k""", ("sam", "gene_model", "introns"))  # fmt: skip
def span_classes(spark, d):
    return reads.classify_spans(*_spans(spark, d))


@register("rewritten_umis", f"""CTE {_MAP}, fixed AS (SELECT barcode, gene, umi_to AS umi, sum(cnt) AS cnt FROM umi_map JOIN nodes USING (barcode, gene, umi) GROUP BY ALL), tops AS (SELECT *, count(*) OVER w AS genes, max(cnt) OVER w AS top FROM fixed WINDOW w AS (PARTITION BY barcode, umi)),
 bad AS (SELECT barcode, gene, umi FROM (SELECT *, count(*) FILTER (cnt = top) OVER (PARTITION BY barcode, umi) AS tops FROM tops) WHERE genes > 1 AND (cnt < top OR tops > 1))
 SELECT t.barcode, t.gene, count(*) AS reads, count(*) FILTER (m.umi <> m.umi_to) AS rewritten, count(b.umi) AS bad FROM tags t JOIN umi_map m ON m.barcode = t.barcode AND m.gene = t.gene AND m.umi = t.umi LEFT JOIN bad b ON b.barcode = t.barcode AND b.gene = t.gene AND b.umi = m.umi_to GROUP BY t.barcode, t.gene""", ("tags",))  # fmt: skip
def rewritten_umis(spark, d):
    tags = view(spark, d, "tags").withColumn("RA", F.lit("E"))
    umi_map = quant.correct_umis(quant.umi_nodes(tags))
    bad = quant.multi_gene_umis(quant.umi_nodes(quant.apply_umi_map(tags, umi_map)))
    x = reads.rewrite_umis(tags, umi_map, bad)
    return x.groupBy("barcode", "gene").agg(F.count("*").alias("reads"), F.count("UR").alias("rewritten"), F.count_if(F.col("RA") == "?").alias("bad"))


_RESULT = "r AS (SELECT *, CASE WHEN NOT barcode_ok THEN 'BARCODE_FAIL' WHEN NOT umi_ok THEN 'UMI_FAIL' WHEN NOT tag_ok THEN 'TAG_FAIL' WHEN kind IS NULL THEN 'UNMAPPED' ELSE kind END AS result FROM results)"


@register("result_rates", f"CTE {_RESULT} SELECT barcode, " + ", ".join(f"count(*) FILTER (result = '{r}') AS align_{r.lower()}" for r in reads.RESULTS if r != "BARCODE_FAIL") + ", count(*) FILTER (corrected) AS align_barcode_corrected FROM r WHERE result <> 'BARCODE_FAIL' GROUP BY barcode", ("results",))
def result_rates(spark, d):
    return reads.result_rates(reads.read_result(view(spark, d, "results")))


@register("alignment_summary", f"CTE {_RESULT} SELECT t.type, count(r.result) AS count, 100::DOUBLE * count(r.result) / (SELECT count(*) FROM r) AS percent FROM (SELECT unnest({reads.RESULTS!r}) AS type) t LEFT JOIN r ON r.result = t.type GROUP BY t.type", ("results",))
def alignment_summary(spark, d):
    return reads.alignment_summary(reads.read_result(view(spark, d, "results")))


@register("preferred_alignments", "SELECT *, row_number() OVER (PARTITION BY read ORDER BY antisense, gene, score DESC, transcript) AS turn FROM align_hits", ("align_hits",))
def preferred_alignments(spark, d):
    return reads.preferred_alignments(view(spark, d, "align_hits"))


_DUPS = "m AS (SELECT *, 3 - len(list_distinct([f1, f2, f3])) AS dups FROM collapsed)"


@register("base_histogram", f"CTE {_DUPS} SELECT least(reads, 65535) AS reads, least(dups, 65535) AS pcr_dups, least(bases, 1000) AS bases, count(*) AS count FROM m WHERE bases > 0 GROUP BY ALL", ("collapsed",))
def base_histogram(spark, d):
    """Two parts, merged."""
    x = reads.fragment_duplicates(view(spark, d, "collapsed"))
    return reads.merge_histograms([reads.base_histogram(x.where("ambiguous")), reads.base_histogram(x.where("not ambiguous"))])


@register("barcode_max_bases", "SELECT barcode, max(bases) AS max_bases, arg_min(reads, (-bases, reads)) AS min_reads FROM collapsed GROUP BY barcode", ("collapsed",))
def barcode_max_bases(spark, d):
    return reads.barcode_max_bases(view(spark, d, "collapsed"))


@register("collapse_counters", f"CTE {_DUPS} SELECT count(*) AS groups, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (lost) AS lost, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(dups) AS BIGINT) AS dups FROM m", ("collapsed",))
def collapse_counters(spark, d):
    return reads.collapse_counters(reads.fragment_duplicates(view(spark, d, "collapsed")))


@register("merged_whitelists", "SELECT w.code, w.cnt + coalesce(n, 0) AS cnt FROM whitelist w LEFT JOIN (SELECT code, count(*) AS n FROM observed GROUP BY code) o ON o.code = w.code", ("whitelist", "observed"))
def merged_whitelists(spark, d):
    return reads.merge_whitelists(view(spark, d, "whitelist"), view(spark, d, "observed").groupBy("code").agg(F.count("*").alias("cnt")))


@register("mixture_counts", """CTE m AS (SELECT cell, CASE WHEN p % 10 = 0 THEN (cell + 1 + o % 39) % 40 ELSE cell END AS to_cell FROM mixed JOIN mix_cells USING (filenum, barcode)), k AS (SELECT to_cell AS cell, count(*) FILTER (cell = to_cell) AS kept, count(*) FILTER (cell <> to_cell) AS ambient FROM m GROUP BY to_cell),
 l AS (SELECT cell, count(*) FILTER (cell <> to_cell) AS lost FROM m GROUP BY cell) SELECT cell, coalesce(kept, 0) AS kept, coalesce(ambient, 0) AS ambient, coalesce(lost, 0) AS lost FROM k FULL JOIN l USING (cell)""", ("mixed", "mix_cells"))  # fmt: skip
def mixture_counts(spark, d):
    x = reads.mixture_cells(view(spark, d, "mixed"), view(spark, d, "mix_cells"))
    return reads.mixture_counts(x.withColumn("to_cell", F.expr("if(p % 10 = 0, (cell + 1 + o % 39) % 40, cell)")))


@register("read_snvs", "SELECT barcode AS molecule, snv, CAST(max(CASE WHEN base = s.alt THEN 1 ELSE 0 END) AS INT) AS alt FROM bases b JOIN snv_list s ON b.tid = s.tid AND b.pos = s.pos AND b.strand = s.strand AND (base = s.ref OR base = s.alt) GROUP BY barcode, snv", ("bases", "snv_list"))
def read_snvs(spark, d):
    return reads.read_snvs(view(spark, d, "bases").drop("ref").withColumnRenamed("barcode", "molecule"), view(spark, d, "snv_list"))


_AT = "CAST(coalesce(CASE s.{0} WHEN 0 THEN A_total WHEN 1 THEN C_total WHEN 2 THEN G_total ELSE T_total END, 0) AS BIGINT) AS {0}_count".format


@register("counts_at_snvs", f"CTE {_POS} SELECT s.tid, s.pos, s.ref, s.alt, {_AT('ref')}, {_AT('alt')}, coalesce(barcodes, 0) AS barcodes FROM snv_list s LEFT JOIN positions p ON p.tid = s.tid AND p.pos = s.pos", ("bases", "snv_list"))
def counts_at_snvs(spark, d):
    return reads.counts_at(pileup.position_counts(view(spark, d, "bases")), view(spark, d, "snv_list"))


@register("target_candidates", f"CTE {_POS}, t AS (SELECT tid, pos, min(alt) AS alt FROM snv_list GROUP BY tid, pos) SELECT s.tid, s.pos, p.ref, s.alt, {_AT('alt')}, {_AT('ref').replace('s.ref', 'p.ref')} FROM t s JOIN positions p ON p.tid = s.tid AND p.pos = s.pos", ("bases", "snv_list"))
def target_candidates(spark, d):
    targets = view(spark, d, "snv_list").groupBy("tid", "pos").agg(F.min("alt").alias("target_alt"))
    return pileup.snv_candidates(pileup.position_counts(view(spark, d, "bases")), targets=targets)


@register("relative_exons", "SELECT transcript, lft, rgt, strand, CAST(upto - (rgt - lft + 1) AS BIGINT) AS rel_lft, CAST(upto - 1 AS BIGINT) AS rel_rgt, intron FROM (SELECT *, sum(rgt - lft + 1) OVER (PARTITION BY transcript ORDER BY CASE WHEN strand = '+' THEN lft ELSE -lft END ROWS UNBOUNDED PRECEDING) AS upto, lead(lft) OVER (PARTITION BY transcript ORDER BY lft) - rgt - 1 AS intron FROM exons)", ("exons",))
def relative_exons(spark, d):
    return reads.relative_exons(view(spark, d, "exons"))


@register("genome_counts", _RATES + ", o AS (SELECT * FROM (VALUES (0, 'hg'), (1, 'hg'), (2, 'mm'), (5, 'mm'), (99, 'mm')) v(gene, organism)) SELECT barcode, " + ", ".join(f"CAST(coalesce(sum({c}) FILTER (organism = '{o}'), 0) AS BIGINT) AS {o}_{n}" for o in ("hg", "mm") for c, n in (("molecules", "exonic"), ("intronic", "intronic"))) + " FROM gene_counts JOIN o USING (gene) GROUP BY barcode", ("tags",))
def genome_counts(spark, d):
    organisms = spark.createDataFrame([(0, "hg"), (1, "hg"), (2, "mm"), (5, "mm"), (99, "mm")], "gene bigint, organism string")
    return reads.genome_counts(quant.molecules(view(spark, d, "tags")), organisms, ["hg", "mm"])


@register("unknown_genes", "SELECT * FROM (VALUES (0, 'MT'), (77, 'RP'), (78, 'RP')) v(gene, grp) WHERE gene NOT IN (SELECT gene FROM tags)", ("tags",))
def unknown_genes(spark, d):
    return quant.unknown_genes(spark.createDataFrame([(0, "MT"), (77, "RP"), (78, "RP")], "gene bigint, grp string"), view(spark, d, "tags"))


_NAMES = "names AS (SELECT chrom, pos, ref, alt, string_agg(DISTINCT source, ',' ORDER BY source) AS known FROM calls GROUP BY ALL)"


@register("known_names", f"CTE {_NAMES} SELECT snv, coalesce(known, '') AS known FROM sites LEFT JOIN names USING (chrom, pos, ref, alt)", ("sites", "calls"))
def known_names(spark, d):
    return annotate.known_names(view(spark, d, "sites"), view(spark, d, "calls")).select("snv", "known")


@register("listed_snvs", "SELECT snv, (chrom, pos, alt) IN (SELECT (chrom, pos, alt) FROM calls WHERE source <> 'raw') AS g1000, ref = 'A' AND alt = 'G' AND (chrom, pos) IN (SELECT (chrom, pos) FROM calls) AS rediportal FROM sites", ("sites", "calls"))
def listed_snvs(spark, d):
    x = annotate.listed(view(spark, d, "sites"), view(spark, d, "calls").where("source <> 'raw'"), ["chrom", "pos", "alt"], "g1000")
    return annotate.edits(x.withColumn("strand_ref", F.col("ref")).withColumn("strand_alt", F.col("alt")), view(spark, d, "calls")).select("snv", "g1000", "rediportal")


@register("repeat_lists", "SELECT s.snv, " + ", ".join(f"string_agg({c}, ',' ORDER BY lft, rgt, rep_name, rep_class, rep_family, rep_strand) AS {c}" for c in annotate.REPEAT) + " FROM sites s LEFT JOIN rmsk r ON s.chrom = r.chrom AND pos BETWEEN lft AND rgt GROUP BY s.snv", ("sites", "rmsk"))
def repeat_lists(spark, d):
    return annotate.repeats(view(spark, d, "sites"), view(spark, d, "rmsk")).select("snv", *annotate.REPEAT)


@register("snv_filtering", "SELECT CASE WHEN NOT purity_ok THEN 'purity' WHEN NOT strand_ok THEN 'strand' ELSE 'passed' END AS reason, count(*) AS count FROM sites GROUP BY ALL", ("sites",))
def snv_filtering(spark, d):
    return annotate.filtering(view(spark, d, "sites"))


@register("passed_calls", "SELECT c.* FROM molecule_calls c WHERE c.snv NOT IN (SELECT snv FROM sites WHERE NOT (purity_ok AND strand_ok)) AND molecule NOT IN (SELECT o FROM mixed WHERE p % 97 = 0)", ("molecule_calls", "sites", "mixed"))
def passed_calls(spark, d):
    failed = view(spark, d, "sites").where("not (purity_ok and strand_ok)")
    x = view(spark, d, "molecule_calls").withColumnRenamed("molecule", "barcode")
    return annotate.without_failed(x, failed, view(spark, d, "mixed").where("p % 97 = 0").select(F.col("o").alias("barcode"))).withColumnRenamed("barcode", "molecule")


@register("annotated_results", "CTE n AS (SELECT chrom, pos, bool_or(source = 'somatic') AS somatic, count(*) AS calls FROM calls GROUP BY chrom, pos) SELECT s.snv, s.chrom, s.pos, coalesce(somatic, false) AS somatic, calls FROM sites s LEFT JOIN n ON n.chrom = s.chrom AND n.pos = s.pos", ("sites", "calls"))
def annotated_results(spark, d):
    notes = view(spark, d, "calls").groupBy("chrom", "pos").agg(F.bool_or(F.col("source") == "somatic").alias("somatic"), F.count("*").alias("calls"), F.max("note").alias("note"))
    return annotate.with_results(view(spark, d, "sites").select("snv", "chrom", "pos"), notes, ["somatic"], ["somatic", "calls"])


@register("snv_set_ids", "CTE x AS (SELECT snv_set, count(*) AS molecules FROM (SELECT string_agg(CAST(snv AS VARCHAR), ',' ORDER BY snv) AS snv_set FROM molecule_calls GROUP BY molecule) GROUP BY snv_set) SELECT *, row_number() OVER (ORDER BY molecules DESC, snv_set) - 1 AS set_id FROM x", ("molecule_calls",))
def snv_set_ids(spark, d):
    return annotate.set_ids(snv.snv_sets(view(spark, d, "molecule_calls")))


@register("molecule_islands", """CTE m AS (SELECT *, CASE WHEN lft > max(rgt) OVER (PARTITION BY molecule ORDER BY lft, rgt, read, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM blocks), p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY molecule ORDER BY lft, rgt, read, part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m),
 w AS (SELECT molecule, island, min(lft) AS lft, max(rgt) AS rgt, count(DISTINCT read) AS reads FROM p GROUP BY molecule, island), s AS (SELECT *, lead(island) OVER t AS nxt, lead(lft) OVER t AS next_lft FROM p WINDOW t AS (PARTITION BY molecule, read ORDER BY part)),
 b AS (SELECT s.molecule, bool_or(nxt <> s.island + 1 OR a.rgt - s.rgt > 5 OR next_lft - n.lft > 5) AS bad FROM s JOIN w a ON a.molecule = s.molecule AND a.island = s.island JOIN w n ON n.molecule = s.molecule AND n.island = s.nxt GROUP BY s.molecule)
 SELECT w.*, coalesce(bad, false) AS ambiguous FROM w LEFT JOIN b USING (molecule)""", ("blocks",))  # fmt: skip
def molecule_islands(spark, d):
    return reads.molecule_islands(view(spark, d, "blocks"))
