"""Registered queries over the test tables, with their DuckDB SQL.

Domain tables are derived views of the test tables; their SQL runs unchanged on both engines but for the spelling of XOR and integer division.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import dna
from cellweave.operators import cells, joins, pileup, quant, sessionize, snv
from cellweave.session import load
from cellweave.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]

#: {x(a, b)}: a XOR b.
VIEWS = {
    "tags": ("lineitem", "SELECT l_suppkey AS barcode, l_partkey % 10 AS gene, ((l_orderkey % 24) * (l_orderkey % 24)) % 1024 AS umi, l_partkey % 7 AS pos, l_returnflag = 'R' AS intronic, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem"),
    "tags_wide": ("lineitem", "SELECT l_suppkey AS barcode, l_partkey % 50 AS gene, (l_orderkey * 31 + l_linenumber * 7) % 1024 AS umi, l_orderkey % 97 AS pos, l_returnflag = 'R' AS intronic FROM lineitem"),
    "observed": ("lineitem", "SELECT CASE WHEN l_linenumber = 7 THEN XOR(l_suppkey * 257 % 65536, (1 + l_orderkey % 3) * CAST(power(4, l_orderkey % 8) AS BIGINT)) WHEN l_linenumber = 6 THEN (l_orderkey * 2654435 + 12345) % 65536 ELSE l_suppkey * 257 % 65536 END AS code, CASE WHEN l_linestatus = 'O' THEN 'a' ELSE 'b' END AS dir, l_returnflag AS file FROM lineitem"),
    "whitelist": ("supplier lineitem", "SELECT w.code, CAST(count(o.l_suppkey) AS BIGINT) AS cnt FROM (SELECT DISTINCT s_suppkey * 257 % 65536 AS code FROM supplier) w LEFT JOIN lineitem o ON o.l_suppkey * 257 % 65536 = w.code AND o.l_linenumber < 6 GROUP BY w.code"),
    "genes": ("part", "SELECT p_brand AS contig, p_partkey AS gid, p_partkey * 37 % 10000 AS lft, p_partkey * 37 % 10000 + p_size * 10 AS rgt, p_type AS label FROM part"),
    "points": ("orders", "SELECT concat('Brand#', CAST(1 + o_orderkey % 25 AS VARCHAR(9))) AS contig, o_orderkey AS pid, o_orderkey * 13 % 10000 AS pos FROM orders"),
    "bases": ("lineitem", "SELECT l_partkey % 5 AS tid, l_partkey % 200 AS pos, (l_partkey % 200) % 4 AS ref, CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS BIGINT) % 4 ELSE (l_partkey % 200) % 4 END AS base, 10 + l_linenumber * 5 AS qual, l_suppkey AS barcode, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_orderkey % 12 AS qdist FROM lineitem"),
    "samples": ("orders", "SELECT DISTINCT o_orderpriority AS tool, o_custkey % 25 AS chrom, o_custkey AS pos, o_orderkey % 3 AS alt FROM orders"),
    "rates": ("orders lineitem", "SELECT o_custkey AS barcode, CAST(count(*) AS BIGINT) AS molecules, CAST(sum(l_linenumber) AS BIGINT) AS reads FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey"),
    "molecule_calls": ("lineitem", "SELECT l_orderkey AS molecule, l_partkey % 40 AS snv, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS alt FROM lineitem GROUP BY l_orderkey, l_partkey % 40"),
    "hits": ("lineitem", "SELECT l_orderkey AS read, CASE l_linenumber % 5 WHEN 0 THEN 'CDNA' WHEN 1 THEN 'CDNA' WHEN 2 THEN 'INTRON' WHEN 3 THEN 'AMBIGUOUS' ELSE CASE WHEN l_quantity > 25 THEN 'ANTISENSE' ELSE 'INTERGENIC' END END AS kind, l_partkey % 3 AS gene, 45 + CAST(l_quantity AS BIGINT) % 6 AS score FROM lineitem"),
    "noted": ("part", "SELECT p_partkey AS snv, substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + (p_partkey + 1 + p_size % 3) % 4 AS INT), 1) AS alt, p_size > 25 AS captured, p_partkey % 2 = 0 AS tool1, p_partkey % 3 = 0 AS tool2, p_partkey % 5 = 0 AS g1000, p_partkey % 7 < 3 AS rediportal, CASE WHEN p_partkey % 11 = 0 THEN 'germline' WHEN p_partkey % 13 = 0 THEN 'somatic' WHEN p_partkey % 17 = 0 THEN 'raw,WGS' ELSE '' END AS known, CASE WHEN p_size % 9 = 0 THEN 'AluY' WHEN p_size % 4 = 0 THEN 'L1' END AS rep_family, p_retailprice / 2000 AS strand_af FROM part"),
}


def _spark_sql(sql: str) -> str:
    import re

    return re.sub(r"XOR\((.*?% 65536), (.*?AS BIGINT\))\)", r"(\1) ^ (\2)", sql).replace("VARCHAR(9)", "STRING")


def _duck(*names: str) -> str:
    return ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n][1].replace('XOR(', 'xor(').replace('VARCHAR(9)', 'VARCHAR')})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    for t in tables.split():
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(_spark_sql(sql), **{t: load(spark, sf_dir, t) for t in tables.split()})


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            more = sql.startswith("CTE ")
            head = f"WITH RECURSIVE {_duck(*views)}{',' if more else ''} " if views else ""
            ORACLE[name] = head + sql.removeprefix("CTE ")
        return f

    return add


@register("barcode_totals", """SELECT dir, file, count(*) AS total, count(*) FILTER (code IN (SELECT code FROM whitelist)) AS correct,
  count(*) FILTER (code NOT IN (SELECT code FROM whitelist) AND code % 7 = 0) AS ambig FROM observed GROUP BY ROLLUP (dir, file)""", ("observed", "whitelist"))
def barcode_totals(spark, d):
    o, w = view(spark, d, "observed"), view(spark, d, "whitelist").select(F.col("code").alias("w"))
    x = o.join(joins.small(w), F.col("code") == F.col("w"), "left").withColumn("status", F.expr("case when w is not null then 0 when code % 7 = 0 then 1 else 2 end"))
    return quant.barcode_totals(x)


@register("barcode_correction", """CTE codes AS (SELECT DISTINCT code FROM observed), digits AS (SELECT unnest(range(8)) AS i), subs AS (SELECT unnest([1, 2, 3]) AS x),
 near AS (SELECT c.code, i, w.code AS w, cnt FROM codes c CROSS JOIN digits CROSS JOIN subs JOIN whitelist w ON w.code = xor(c.code, x * CAST(power(4, i) AS BIGINT)) WHERE cnt > 0 AND c.code NOT IN (SELECT code FROM whitelist)),
 best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY code ORDER BY cnt DESC, i, w) = 1)
 SELECT c.code, CASE WHEN e.code IS NOT NULL THEN 0 WHEN b.w IS NOT NULL THEN 2 ELSE 1 END AS status, coalesce(e.code, b.w) AS corrected FROM codes c LEFT JOIN whitelist e ON e.code = c.code LEFT JOIN best b ON b.code = c.code""", ("observed", "whitelist"))
def barcode_correction(spark, d):
    return joins.correct_barcodes(view(spark, d, "observed"), view(spark, d, "whitelist"), 8)


_NODES = "nodes AS MATERIALIZED (SELECT barcode, gene, umi, count(*) AS cnt FROM tags GROUP BY ALL)"
_EDGE = "bit_count(CAST((xor(a.umi, b.umi) | (xor(a.umi, b.umi) >> 1)) & 341 AS BIGINT)) = 1 AND ((a.cnt = 1 AND b.cnt = 1) OR (greatest(a.cnt, b.cnt) > 1 AND greatest(a.cnt, b.cnt) >= 2 * least(a.cnt, b.cnt) - 1))"
_MAP = f"""{_NODES}, edges AS MATERIALIZED (SELECT a.barcode, a.gene, a.umi AS u, b.umi AS v FROM nodes a JOIN nodes b ON a.barcode = b.barcode AND a.gene = b.gene AND a.umi <> b.umi WHERE {_EDGE}),
 reach AS (SELECT barcode, gene, umi, umi AS seen FROM nodes UNION SELECT r.barcode, r.gene, r.umi, e.v FROM reach r JOIN edges e ON e.barcode = r.barcode AND e.gene = r.gene AND e.u = r.seen),
 umi_map AS MATERIALIZED (SELECT r.barcode, r.gene, r.umi, arg_max(n.umi, n.cnt * 10000 - n.umi) AS umi_to FROM reach r JOIN nodes n ON n.barcode = r.barcode AND n.gene = r.gene AND n.umi = r.seen GROUP BY r.barcode, r.gene, r.umi)"""


@register("umi_edges", f"CTE {_NODES} SELECT a.barcode, a.gene, count(*) AS edges, CAST(sum(a.umi * 1024 + b.umi) AS BIGINT) AS mark FROM nodes a JOIN nodes b ON a.barcode = b.barcode AND a.gene = b.gene AND bit_count(CAST((xor(a.umi, b.umi) | (xor(a.umi, b.umi) >> 1)) & 341 AS BIGINT)) = 1 GROUP BY a.barcode, a.gene", ("tags",))
def umi_edges(spark, d):
    nodes = quant.umi_nodes(view(spark, d, "tags")).withColumnRenamed("umi", "code")
    return joins.hamming1_pairs(nodes, ["barcode", "gene"], 5).groupBy("barcode", "gene").agg(F.count("*").alias("edges"), F.sum(F.expr("a * 1024 + b")).alias("mark"))


@register("umi_components", f"CTE {_MAP} SELECT m.barcode, m.gene, m.umi, n.cnt, m.umi_to FROM umi_map m JOIN nodes n USING (barcode, gene, umi)", ("tags",))
def umi_components(spark, d):
    return quant.correct_umis(quant.umi_nodes(view(spark, d, "tags")))


_BAD = "nodes AS MATERIALIZED (SELECT barcode, gene, umi, count(*) AS cnt FROM tags_wide GROUP BY ALL), tops AS (SELECT *, count(*) OVER w AS genes, max(cnt) OVER w AS top FROM nodes WINDOW w AS (PARTITION BY barcode, umi)), bad AS MATERIALIZED (SELECT barcode, gene, umi, cnt FROM (SELECT *, count(*) FILTER (cnt = top) OVER (PARTITION BY barcode, umi) AS tops FROM tops) WHERE genes > 1 AND (cnt < top OR tops > 1))"


@register("multi_gene_umis", f"CTE {_BAD} SELECT * FROM bad", ("tags_wide",))
def multi_gene_umis(spark, d):
    return quant.multi_gene_umis(quant.umi_nodes(view(spark, d, "tags_wide")))


_MOLS = """mols AS (SELECT barcode, gene, umi, bool_or(intronic) AS intronic, count(*) AS reads, count(DISTINCT pos) AS places FROM {t} GROUP BY ALL),
 gene_counts AS MATERIALIZED (SELECT barcode, gene, count(*) FILTER (NOT intronic) AS molecules, CAST(coalesce(sum(reads) FILTER (NOT intronic), 0) AS BIGINT) AS reads, CAST(coalesce(sum(reads - places) FILTER (NOT intronic), 0) AS BIGINT) AS pcr_dups,
  count(*) FILTER (intronic) AS intronic, CAST(coalesce(sum(reads) FILTER (intronic), 0) AS BIGINT) AS intron_reads, CAST(coalesce(sum(reads - places) FILTER (intronic), 0) AS BIGINT) AS intron_pcr_dups, CAST(0 AS BIGINT) AS discarded FROM mols GROUP BY ALL)"""


@register("molecules_by_gene", f"""CTE {_MAP}, fixed AS (SELECT t.barcode, t.gene, m.umi_to AS umi, t.pos, t.intronic FROM tags t JOIN umi_map m USING (barcode, gene, umi)), {_MOLS.format(t='fixed')} SELECT * FROM gene_counts""", ("tags",))
def molecules_by_gene(spark, d):
    tags = view(spark, d, "tags")
    return quant.molecules(quant.apply_umi_map(tags, quant.correct_umis(quant.umi_nodes(tags))))


@register("molecules_discarded", f"""CTE {_BAD}, good AS (SELECT t.* FROM tags_wide t ANTI JOIN bad USING (barcode, gene, umi)), {_MOLS.format(t='good')}, lost AS (SELECT barcode, gene, CAST(sum(cnt) AS BIGINT) AS lost FROM bad GROUP BY ALL)
 SELECT barcode, gene, coalesce(molecules, 0) AS molecules, coalesce(intronic, 0) AS intronic, coalesce(reads, 0) AS reads, coalesce(pcr_dups, 0) AS pcr_dups, coalesce(intron_reads, 0) AS intron_reads, coalesce(intron_pcr_dups, 0) AS intron_pcr_dups, coalesce(lost, 0) AS discarded FROM gene_counts FULL JOIN lost USING (barcode, gene)""", ("tags_wide",))
def molecules_discarded(spark, d):
    tags = view(spark, d, "tags_wide")
    return quant.molecules(tags, quant.multi_gene_umis(quant.umi_nodes(tags)))


_RATES = f"CTE {_MOLS.format(t='tags')}"


_BY_BARCODE = "SELECT barcode, CAST(sum(molecules) AS BIGINT) AS molecules, count(*) FILTER (molecules > 0) AS genes, CAST(sum(pcr_dups) AS BIGINT) AS pcr_dups, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(intronic) AS BIGINT) AS intron_molecules, CAST(sum(intron_pcr_dups) AS BIGINT) AS intron_pcr_dups, CAST(sum(intron_reads) AS BIGINT) AS intron_reads, CAST(sum(discarded) AS BIGINT) AS discarded_reads FROM gene_counts GROUP BY barcode"


@register("barcode_rates", f"{_RATES} {_BY_BARCODE}", ("tags",))
def barcode_rates(spark, d):
    return quant.barcode_rates(quant.molecules(view(spark, d, "tags")))


@register("gene_group_counts", _RATES + ", grp AS (SELECT 0 AS gene, 'MT' AS g UNION ALL SELECT 1, 'MT' UNION ALL SELECT 1, 'RP' UNION ALL SELECT 77, 'RP') SELECT barcode, CAST(coalesce(sum(molecules) FILTER (g = 'MT'), 0) AS BIGINT) AS \"group_MT\", CAST(coalesce(sum(molecules) FILTER (g = 'RP'), 0) AS BIGINT) AS \"group_RP\" FROM gene_counts JOIN grp USING (gene) GROUP BY barcode", ("tags",))
def gene_group_counts(spark, d):
    groups = spark.createDataFrame([(0, "MT"), (1, "MT"), (1, "RP"), (77, "RP")], "gene bigint, grp string")
    return quant.group_counts(quant.molecules(view(spark, d, "tags")), F.broadcast(groups), ["MT", "RP"])


@register("duplicate_summary", _RATES + """, s AS (SELECT sum(molecules)::BIGINT AS m, sum(reads)::BIGINT AS r, sum(pcr_dups)::BIGINT AS d, sum(intronic)::BIGINT AS im, sum(intron_reads)::BIGINT AS ir, sum(intron_pcr_dups)::BIGINT AS id FROM gene_counts)
 SELECT r + ir AS all_reads, m + im AS all_molecules, d + id AS all_pcr_dups, CAST(0 AS BIGINT) AS discarded, 100 - 100::DOUBLE * m / nullif(r, 0) AS cdna_umi_percent, 100::DOUBLE * d / nullif(r, 0) AS cdna_pcr_percent, 100 - 100::DOUBLE * im / nullif(ir, 0) AS intron_umi_percent,
 100::DOUBLE * id / nullif(ir, 0) AS intron_pcr_percent, 100 - 100::DOUBLE * (m + im) / nullif(r + ir, 0) AS total_umi_percent, 100::DOUBLE * (d + id) / nullif(r + ir, 0) AS total_pcr_percent FROM s""", ("tags",))
def duplicate_summary(spark, d):
    return quant.duplicate_summary(quant.molecules(view(spark, d, "tags")))


@register("duplicate_flags", "SELECT barcode, count(*) - count(DISTINCT (gene, umi, pos)) AS dups, count(*) AS reads FROM tags GROUP BY barcode", ("tags",))
def duplicate_flags(spark, d):
    x = quant.flag_duplicates(view(spark, d, "tags"), ["barcode", "gene", "umi", "pos"], ["strand"])
    return x.groupBy("barcode").agg(F.count_if("dup").alias("dups"), F.count("*").alias("reads"))


@register("read_classes", """CTE best AS (SELECT * FROM hits QUALIFY score >= max(score) OVER (PARTITION BY read) - 3), n AS (SELECT read, count(DISTINCT gene) FILTER (kind = 'CDNA') AS c, count(*) FILTER (kind = 'INTRON') AS i, count(*) FILTER (kind = 'INTERGENIC') AS x,
 count(*) FILTER (kind = 'AMBIGUOUS') AS m, count(*) FILTER (kind = 'ANTISENSE') AS s, max(gene) FILTER (kind = 'CDNA') AS cg, max(gene) FILTER (kind = 'INTRON') AS ig FROM best GROUP BY read)
 SELECT read, CASE WHEN i = 1 AND c = 1 AND cg = ig THEN 'AMBIGUOUS' WHEN c + i + x > 1 OR (x > 0 AND s > 0) THEN 'MULTIMAPPED' WHEN c + i + x = 0 AND m > 0 THEN 'AMBIGUOUS' WHEN c + i + x = 0 AND s > 0 THEN 'ANTISENSE' WHEN i = 1 THEN 'INTRONIC' WHEN c = 1 THEN 'CDNA' WHEN x = 1 THEN 'INTERGENIC' ELSE 'AMBIGUOUS' END AS result FROM n""", ("hits",))
def read_classes(spark, d):
    return quant.classify_reads(view(spark, d, "hits"))


@register("interval_overlaps", "SELECT p.pid, count(*) AS n, CAST(sum(g.gid) AS BIGINT) AS mark FROM points p JOIN genes g ON p.contig = g.contig AND p.pos <= g.rgt AND g.lft <= p.pos + 90 GROUP BY p.pid", ("points", "genes"))
def interval_overlaps(spark, d):
    p = view(spark, d, "points").withColumn("stop", F.expr("pos + 90"))
    return joins.overlap_totals(p, view(spark, d, "genes"), ["contig"], ("pos", "stop"), ("lft", "rgt"), "gid").groupBy("pid").agg(F.sum("n").alias("n"), F.sum("total").alias("mark"))


@register("point_annotations", "SELECT p.pid, coalesce(string_agg(g.label, ',' ORDER BY g.label), '') AS labels, count(g.label) > 0 AS covered FROM points p LEFT JOIN genes g ON p.contig = g.contig AND p.pos BETWEEN g.lft AND g.rgt GROUP BY p.pid", ("points", "genes"))
def point_annotations(spark, d):
    return joins.annotate_overlaps(view(spark, d, "points"), view(spark, d, "genes"), "contig", "pos", ("lft", "rgt"), "label").select("pid", "labels", "covered")


@register("nearest_sites", "SELECT p.pid, coalesce(min(p.pos - g.lft) FILTER (p.pos - g.lft BETWEEN 0 AND 10), 11) AS below, coalesce(min(g.lft - p.pos) FILTER (g.lft - p.pos BETWEEN 0 AND 10), 11) AS above FROM points p LEFT JOIN genes g ON p.contig = g.contig AND abs(p.pos - g.lft) <= 10 GROUP BY p.pid", ("points", "genes"))
def nearest_sites(spark, d):
    p, g = view(spark, d, "points"), view(spark, d, "genes")
    x = joins.nearest_site(p, g, "contig", "pos", "lft", 10, above=False).withColumnRenamed("distance", "below")
    return joins.nearest_site(x, g, "contig", "pos", "lft", 10, above=True).select("pid", "below", F.col("distance").alias("above"))


_BLOCKS = "CTE marked AS (SELECT *, CASE WHEN lft > max(rgt) OVER (PARTITION BY contig ORDER BY lft, rgt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM genes), numbered AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY lft, rgt ROWS UNBOUNDED PRECEDING) AS block FROM marked), blocks AS (SELECT contig, CAST(block AS BIGINT) AS block, min(lft) AS lft, max(rgt) AS rgt, count(*) AS n FROM numbered GROUP BY ALL)"


@register("merged_blocks", _BLOCKS + " SELECT * FROM blocks", ("genes",))
def merged_blocks(spark, d):
    return sessionize.merged_blocks(view(spark, d, "genes"), ["contig"], "lft", "rgt")


@register("intron_gaps", _BLOCKS + " SELECT contig, rgt + 1 AS lft, next - 1 AS rgt FROM (SELECT *, lead(lft) OVER (PARTITION BY contig ORDER BY lft) AS next FROM blocks) WHERE next > rgt + 1", ("genes",))
def intron_gaps(spark, d):
    return sessionize.block_gaps(sessionize.merged_blocks(view(spark, d, "genes"), ["contig"], "lft", "rgt"), ["contig"])


@register("gap_sessions", "CTE m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY contig ORDER BY pos, pid) > 20 THEN 1 ELSE 0 END AS new FROM points) SELECT pid, CAST(sum(new) OVER (PARTITION BY contig ORDER BY pos, pid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m", ("points",))
def gap_sessions(spark, d):
    return sessionize.gap_groups(view(spark, d, "points"), ["contig"], "pos", 20, ["pid"]).select("pid", "session")


@register("capped_sessions", "SELECT contig, count(*) AS n FROM points GROUP BY contig HAVING count(*) <= 600", ("points",))
def capped_sessions(spark, d):
    return sessionize.cap_sessions(view(spark, d, "points"), ["contig"], 600).groupBy("contig").agg(F.count("*").alias("n"))


_PER = ", ".join(f"count(*) FILTER (qual >= 20 AND base = {b}) AS {x}_total, count(DISTINCT barcode) FILTER (qual >= 20 AND base = {b}) AS {x}_barcodes, count(*) FILTER (qual >= 20 AND base = {b} AND strand = '+') AS {x}_plus, count(*) FILTER (qual >= 20 AND base = {b} AND strand = '-') AS {x}_minus, count(DISTINCT barcode) FILTER (qual >= 20 AND base = {b} AND strand = '+') AS {x}_plus_barcodes, count(DISTINCT barcode) FILTER (qual >= 20 AND base = {b} AND strand = '-') AS {x}_minus_barcodes, count(DISTINCT barcode) FILTER (qual >= 20 AND base = {b} AND has_ref) AS {x}_with_ref_barcodes, coalesce(max(qdist) FILTER (qual >= 20 AND base = {b}), 0) AS {x}_edge" for b, x in enumerate("ACGT"))
_POS = f"positions AS MATERIALIZED (SELECT tid, pos, ref, count(*) FILTER (qual >= 20) AS coverage, count(*) FILTER (qual < 20) AS failed_count, count(DISTINCT barcode) FILTER (qual >= 20) AS barcodes, count(DISTINCT barcode) FILTER (qual >= 20 AND strand = '+') AS plus_barcodes, count(DISTINCT barcode) FILTER (qual >= 20 AND strand = '-') AS minus_barcodes, count(DISTINCT barcode) FILTER (qual >= 20 AND base = ref) AS ref_barcodes, {_PER} FROM (SELECT *, coalesce(bool_or(base = ref AND qual >= 20) OVER (PARTITION BY tid, pos, ref, barcode), false) AS has_ref FROM bases) GROUP BY tid, pos, ref)"


@register("pileup_positions", f"CTE {_POS} SELECT * FROM positions", ("bases",))
def pileup_positions(spark, d):
    return pileup.position_counts(view(spark, d, "bases"))


_CAND = f"CTE {_POS}, alts AS (" + " UNION ALL ".join(f"SELECT tid, pos, ref, {b} AS alt, {x}_total AS n, {x}_barcodes AS b, {x}_edge AS edge FROM positions WHERE barcodes >= 5" for b, x in enumerate("ACGT")) + "), best AS (SELECT * FROM alts WHERE alt <> ref AND b >= 2 QUALIFY row_number() OVER (PARTITION BY tid, pos ORDER BY n DESC, alt) = 1), cand AS (SELECT b.tid, b.pos, b.ref, b.alt, b.n AS alt_count, r.n AS ref_count FROM best b JOIN alts r ON r.tid = b.tid AND r.pos = b.pos AND r.alt = b.ref WHERE b.n >= 0.01 * (b.n + r.n) AND b.edge >= 5)"


@register("snv_candidates", _CAND + " SELECT *, row_number() OVER (ORDER BY tid, pos) - 1 AS snp FROM cand", ("bases",))
def snv_candidates(spark, d):
    return pileup.number_snvs(pileup.snv_candidates(pileup.position_counts(view(spark, d, "bases"))))


@register("cell_base_counts", _CAND + " SELECT b.tid, b.pos, b.barcode, b.base, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus FROM bases b SEMI JOIN cand c ON b.tid = c.tid AND b.pos = c.pos WHERE qual >= 20 GROUP BY ALL", ("bases",))
def cell_base_counts(spark, d):
    b = view(spark, d, "bases")
    return pileup.cell_base_counts(b, pileup.snv_candidates(pileup.position_counts(b)))


@register("barcode_coverage", "SELECT barcode, count(DISTINCT (tid, pos)) AS bases_covered, count(*) AS bases FROM bases WHERE qual >= 20 GROUP BY barcode", ("bases",))
def barcode_coverage(spark, d):
    return pileup.barcode_coverage(view(spark, d, "bases"))


@register("consensus_bases", "CTE per AS (SELECT barcode, tid, base, count(*) AS n, max(qual) AS q FROM bases GROUP BY ALL), top AS (SELECT *, sum(n) OVER (PARTITION BY barcode, tid) AS depth FROM per QUALIFY row_number() OVER (PARTITION BY barcode, tid ORDER BY n DESC, base) = 1) SELECT barcode, tid, CASE WHEN n >= 0.6 * depth THEN base ELSE 4 END AS base, CASE WHEN n >= 0.6 * depth THEN q ELSE 0 END AS qual, CAST(depth AS BIGINT) AS depth FROM top", ("bases",))
def consensus_bases(spark, d):
    return pileup.consensus(view(spark, d, "bases"), ["barcode", "tid"])


_CALLS = "CTE c AS (SELECT tid, pos, count(*) FILTER (base = ref AND strand = '+') AS ref_plus, count(*) FILTER (base = ref AND strand = '-') AS ref_minus, count(*) FILTER (base = (ref + 1) % 4 AND strand = '+') AS alt_plus, count(*) FILTER (base = (ref + 1) % 4 AND strand = '-') AS alt_minus, count(*) AS total, substr('ACGT', CAST(ref + 1 AS INT), 1) AS ref, substr('ACGT', CAST((ref + 1) % 4 + 1 AS INT), 1) AS alt FROM bases GROUP BY tid, pos, bases.ref), p AS (SELECT *, (ref_plus + ref_minus + alt_plus + alt_minus) / total::DOUBLE AS purity, (ref_plus + alt_plus) / nullif(ref_plus + ref_minus + alt_plus + alt_minus, 0)::DOUBLE AS sp FROM c)"


@register("stranded_calls", _CALLS + " SELECT tid, pos, purity, CASE WHEN sp >= 0.55 THEN '+' WHEN sp <= 1 - 0.55 + 1e-12 THEN '-' ELSE '?' END AS strand, CASE WHEN sp <= 1 - 0.55 + 1e-12 THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS strand_ref, coalesce(purity >= 0.9 AND (sp >= 0.55 OR sp <= 1 - 0.55 + 1e-12), false) AS passed FROM p", ("bases",))
def stranded_calls(spark, d):
    b, alt = view(spark, d, "bases"), F.expr("(ref + 1) % 4")
    n = lambda base, s: F.count_if((F.col("base") == base) & (F.col("strand") == s))
    x = b.groupBy("tid", "pos", F.col("ref").alias("r")).agg(*(f.alias(k) for k, f in (("ref_plus", n(F.col("ref"), "+")), ("ref_minus", n(F.col("ref"), "-")), ("alt_plus", n(alt, "+")), ("alt_minus", n(alt, "-")))), F.count("*").alias("total"))
    x = x.withColumn("ref", F.expr("substring('ACGT', cast(r + 1 as int), 1)")).withColumn("alt", F.expr("substring('ACGT', cast((r + 1) % 4 + 1 as int), 1)"))
    return snv.stranded_calls(x, 0.9, 0.55).select("tid", "pos", "purity", "strand", "strand_ref", "passed")


@register("snv_pair_tables", "SELECT a.snv AS s1, b.snv AS s2, count(*) FILTER (a.alt = 0 AND b.alt = 0) AS rr, count(*) FILTER (a.alt = 1 AND b.alt = 1) AS aa, count(*) FILTER (a.alt = 0 AND b.alt = 1) AS ra, count(*) FILTER (a.alt = 1 AND b.alt = 0) AS ar FROM molecule_calls a JOIN molecule_calls b ON a.molecule = b.molecule AND a.snv < b.snv GROUP BY a.snv, b.snv", ("molecule_calls",))
def snv_pair_tables(spark, d):
    return snv.pair_tables(view(spark, d, "molecule_calls"))


@register("snv_sets", "SELECT snv_set, count(*) AS molecules FROM (SELECT string_agg(CAST(snv AS VARCHAR), ',' ORDER BY snv) AS snv_set FROM molecule_calls GROUP BY molecule) GROUP BY snv_set", ("molecule_calls",))
def snv_sets(spark, d):
    return snv.snv_sets(view(spark, d, "molecule_calls"))


@register("snv_occupancy", "SELECT snv, count(*) FILTER (r + a > 0) AS any, count(*) FILTER (r > 0 AND a > 0) AS both, count(*) FILTER (r > 0 AND a = 0) AS ref_only, count(*) FILTER (r = 0 AND a > 0) AS alt_only FROM (SELECT pos AS snv, barcode, count(*) FILTER (base = ref) AS r, count(*) FILTER (base <> ref) AS a FROM bases GROUP BY ALL) GROUP BY snv", ("bases",))
def snv_occupancy(spark, d):
    b = view(spark, d, "bases").withColumnRenamed("pos", "snv")
    ref, alt = (b.where(t).groupBy("snv", "barcode").agg(F.count("*").alias("value")) for t in ("base = ref", "base <> ref"))
    return snv.occupancy(snv.align_counts(ref, alt))


TOOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_TOOLS = ", ".join(f"'{t}'" for t in TOOLS)


@register("merge_tools", f"CTE o AS (SELECT *, list_position([{_TOOLS}], tool) AS turn FROM samples), k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY chrom, pos, alt ORDER BY turn DESC) = 1), k2 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY turn DESC, alt DESC) = 1), s AS (SELECT chrom, pos, " + ", ".join(f"CAST(bool_or(tool = '{t}') AS INT) AS tool_{i}" for i, t in enumerate(TOOLS)) + " FROM samples GROUP BY ALL) SELECT chrom, pos, alt, " + ", ".join(f"tool_{i}" for i in range(5)) + " FROM k2 JOIN s USING (chrom, pos)", ("samples",))
def merge_tools(spark, d):
    return snv.merge_tools(view(spark, d, "samples"), TOOLS)


@register("genome_union", "CTE a AS (SELECT chrom, pos, max(alt) AS alt FROM samples WHERE tool < '4' GROUP BY ALL), g AS (SELECT chrom, pos, min(alt) AS alt FROM samples WHERE tool > '2' GROUP BY ALL) SELECT chrom, pos, coalesce(a.alt, g.alt) AS alt, CAST(g.alt IS NOT NULL AS INT) AS genome FROM a FULL JOIN g USING (chrom, pos) WHERE a.alt IS NULL OR g.alt IS NULL OR a.alt = g.alt", ("samples",))
def genome_union(spark, d):
    s = view(spark, d, "samples")
    return snv.genome_union(s.where("tool < '4'").groupBy("chrom", "pos").agg(F.max("alt").alias("alt")), s.where("tool > '2'").groupBy("chrom", "pos").agg(F.min("alt").alias("alt")))


@register("coverage_intersection", "SELECT chrom, pos FROM samples WHERE tool < '2' INTERSECT SELECT chrom, pos FROM samples WHERE tool > '4'", ("samples",))
def coverage_intersection(spark, d):
    s = view(spark, d, "samples")
    return snv.coverage_intersection(s.where("tool < '2'"), s.where("tool > '4'"))


@register("overlap_summary", "SELECT ref || '>' || alt AS sub, captured, count(*) FILTER (tool1 AND NOT tool2) AS tool1_only, count(*) FILTER (tool2 AND NOT tool1) AS tool2_only, count(*) FILTER (tool1 AND tool2) AS overlap FROM noted GROUP BY CUBE (sub, captured)", ("noted",))
def overlap_summary(spark, d):
    return snv.overlap_summary(view(spark, d, "noted"))


@register("snv_groups", "SELECT snv, concat_ws(',', CASE WHEN (rediportal OR coalesce(contains(rep_family, 'Alu'), false)) AND ref = 'A' AND alt = 'G' THEN 'edit' END, CASE WHEN g1000 AND NOT (ref || '>' || alt IN ('A>G', 'G>A', 'C>T', 'T>C')) THEN 'gtv' END, CASE WHEN (contains(known, 'germline') OR contains(known, 'WGS')) AND captured THEN 'germ' END) AS label FROM noted", ("noted",))
def snv_groups(spark, d):
    g = snv.GroupBuilder().add_group("edit", "A to G edits", "A_to_G_edit").add_group("gtv", "known transversions", "g1000", "~transition").add_group("germ", "captured germline", "germline", "captured")
    return view(spark, d, "noted").select("snv", g.label().alias("label"))


@register("export_filters", "SELECT snv FROM noted WHERE strand_af <= 0.999 AND (known <> '' OR g1000)", ("noted",))
def export_filters(spark, d):
    return snv.export_filter(view(spark, d, "noted"), "keep-annotated").select("snv")


_RANK = "CTE r AS (SELECT barcode, molecules, row_number() OVER w AS rnk, CAST(sum(molecules) OVER w AS BIGINT) AS cum FROM rates WINDOW w AS (ORDER BY molecules DESC, barcode ROWS UNBOUNDED PRECEDING))"


@register("cell_ranks", _RANK + " SELECT * FROM r", ("rates",))
def cell_ranks(spark, d):
    return cells.ranked(view(spark, d, "rates")).select("barcode", "molecules", F.col("rnk").cast("bigint"), F.col("cum").cast("bigint"))


@register("cell_knee", _RANK + ", e AS (SELECT max(rnk) AS n, max(cum) AS t, arg_min(cum, rnk) AS f FROM r) SELECT rnk, molecules FROM r, e ORDER BY round(abs((1 - f / t::DOUBLE) * log10(rnk) - log10(n) * (cum / t::DOUBLE - f / t::DOUBLE)) / sqrt(pow(1 - f / t::DOUBLE, 2) + pow(log10(n), 2)), 9) DESC, rnk LIMIT 1", ("rates",))
def cell_knee(spark, d):
    return cells.knee(cells.ranked(view(spark, d, "rates")))


@register("mad_outliers", "CTE m AS (SELECT median(molecules) AS med FROM rates), a AS (SELECT med, median(abs(molecules - med)) / 0.6744897501960817 AS mad FROM rates, m GROUP BY med) SELECT barcode, molecules FROM rates, a WHERE molecules >= med - least(mad * 1.5, 10)", ("rates",))
def mad_outliers(spark, d):
    return cells.mad_filter(view(spark, d, "rates"), "molecules", 1.5, 10, low=True).select("barcode", "molecules")


@register("rate_quartiles", "SELECT " + ", ".join(f"quantile_cont({v}, {q}) AS {v}_q{i + 1}" for v in ("molecules", "reads") for i, q in enumerate((0.25, 0.5, 0.75))) + " FROM rates", ("rates",))
def rate_quartiles(spark, d):
    return cells.quartiles(view(spark, d, "rates"), ["molecules", "reads"])


@register("unique_names", "SELECT gid, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || '-' || row_number() OVER (PARTITION BY label ORDER BY gid) ELSE label END AS unique_name FROM genes", ("genes",))
def unique_names(spark, d):
    return cells.suffix_names(view(spark, d, "genes"), "label", ["gid"]).select("gid", "unique_name")


_SEQ = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"


@register("sequence_functions", f"CTE s AS (SELECT doc_id, {_SEQ} AS s FROM documents) SELECT doc_id, s, translate(reverse(s), 'ACGT', 'TGCA') AS rc, CASE WHEN length(s) - length(rtrim(s, 'A')) < 6 THEN length(s) WHEN (length(s) - length(rtrim(s, 'A'))) * 2 <= length(s) THEN length(rtrim(s, 'A')) END AS kept, CASE WHEN length(s) >= 3 THEN (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM (SELECT substr(s, CAST(i AS INT), 3) AS t FROM (SELECT unnest(range(1, length(s) - 1)) AS i)) GROUP BY t)) / (length(s) - 2) END AS dust FROM s".replace("CTE s", "WITH s"))
def sequence_functions(spark, d):
    s = F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s")
    return load(spark, d, "documents").select("doc_id", s).select("doc_id", "s", dna.reverse_complement("s").alias("rc"), dna.trim_tail("s").alias("kept"), dna.dust("s").alias("dust"))


@register("umi_validity", "SELECT code, regexp_matches(s, '^[ACGT]+$') AND NOT (s = repeat(substr(s, 1, 1), 8)) AS ok, s FROM (SELECT DISTINCT code, " + " || ".join(f"substr('ACGT', CAST((code >> {2 * i}) & 3 AS INT) + 1, 1)" for i in range(7, -1, -1)) + " AS s FROM observed)", ("observed",))
def umi_validity(spark, d):
    x = view(spark, d, "observed").select("code").distinct().withColumn("s", dna.decode("code", 8))
    return x.where(dna.encode("s") == F.col("code")).select("code", dna.valid_umi("s").alias("ok"), "s")


@register("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    return windows.tumbling(load(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("sliding_windows", "SELECT b - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events) CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def sliding_windows(spark, d):
    return windows.sliding(load(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("session_windows", "WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    x = windows.sessions(load(spark, d, "events"))
    return x.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@register("streaming_pileup", "SELECT tid, pos, base, count(*) AS n, max(qual) AS qual FROM bases GROUP BY ALL", ("bases",))
def streaming_pileup(spark, d):
    """The micro-batch result of a stream over lineitem."""
    schema = load(spark, d, "lineitem").schema
    rows = windows.stream(spark, d, schema, "lineitem.parquet")
    rows.createOrReplaceTempView("lineitem_stream")
    bases = spark.sql(_spark_sql(VIEWS["bases"][1]).replace("FROM lineitem", "FROM lineitem_stream"))
    name = "streaming_pileup_out"
    windows.to_memory(windows.position_counts(bases), name).stop()
    return spark.table(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules, genes and duplicates of every barcode, after UMI correction."""
    tags = view(spark, sf_dir, "tags")
    return quant.barcode_rates(quant.molecules(quant.apply_umi_map(tags, quant.correct_umis(quant.umi_nodes(tags)))))
