"""Alignment, annotation, source and sink operators: hand fixtures, and registered queries against DuckDB."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cellweave.operators import cells, joins, quant, reads, sessionize
from cellweave.plans import queries, read_queries  # noqa: F401  (registers)
from cellweave.session import TABLES
from cellweave.sources import readers, sinks

D = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__.endswith("read_queries")]


def rows(table):
    one = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return Counter(tuple(one(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in sorted(table.column_names)), strict=True))


@pytest.mark.parametrize("name", [*NAMES, "molecules_by_gene", "molecules_discarded", "barcode_rates", "duplicate_summary", "gene_group_counts", "pileup_positions", "snv_groups", "sequence_functions"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, D).toArrow(), con.sql(queries.ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


def test_sessions_of_many_tiles(spark, monkeypatch):
    """Sessions don't depend on the tiles; null keys and positions are groups of their own."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(4000), rng.choice([3, 20, 900])) for i in range(500)]
    df = spark.createDataFrame(rows, "contig string, id long, lft long, size long").withColumn("rgt", F.col("lft") + F.col("size"))
    monkeypatch.setattr(sessionize, "TILE", 64)
    got = {r.id: (r.session, r.gap) for r in sessionize.gap_groups(sessionize.overlap_groups(df, ["contig"], "lft", "rgt", ["id"]).withColumnRenamed("session", "gap"), ["contig"], "lft", 15, ["id"]).collect()}
    for c in ("a", "b", None):
        end, last, session, gap = None, None, 0, 0
        for lft, rgt, i in sorted((p, p + n, i) for k, i, p, n in rows if k == c):
            gap += end is not None and lft > end
            end = rgt if end is None else max(end, rgt)
            session += last is not None and lft - last > 15
            last = lft
            assert got[i] == (session, gap)


def test_interval_join_of_all_lengths(spark):
    rng = random.Random(7)
    span = lambda: (p := rng.randrange(3_000_000), p + rng.choice([0, 5, 300, 5000, 400_000, 9_000_000]))
    left, right = [(i, "c", *span()) for i in range(150)], [(i, "c", *span()) for i in range(150)]
    x, y = spark.createDataFrame(left, "i long, on_ string, a long, b long"), spark.createDataFrame(right, "j long, on_ string, c long, d long")
    want = Counter((i, j) for i, _, a, b in left for j, _, c, d in right if a <= d and c <= b)
    assert Counter((r.i, r.j) for r in joins.interval_join(x, y, "on_", ("a", "b"), ("c", "d")).collect()) == want
    assert joins.interval_join(x, y.limit(0), "on_", ("a", "b"), ("c", "d")).count() == 0


def test_overlap_joins_broadcast_by_dealt_rows(spark, monkeypatch):
    """A side that deals to more rows than the bound is not broadcast, however small its file; a few long ranges count with all their bins."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    x, y = spark.createDataFrame([("c", 5)], "k string, p long"), spark.createDataFrame([("c", 0, 10**13, "l"), ("c", 0, 9, None), ("d", 0, 9, None)], "k string, a long, b long, l string")
    assert "Broadcast" not in plan(joins.interval_join(x, y, "k", ("p", "p"), ("a", "b")))
    assert "Broadcast" in plan(joins.interval_join(x, y.where("b = 9"), "k", ("p", "p"), ("a", "b")))
    monkeypatch.setattr(joins, "DEALT_ROWS", 50)
    query = queries.QUERIES["point_annotations"](spark, D)
    assert "Broadcast" not in plan(query)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    assert rows(query.toArrow()) == rows(con.sql(queries.ORACLE["point_annotations"]).to_arrow_table())
    points = spark.createDataFrame([("c", 5), ("d", 5), (None, 5)], "k string, p long")
    found = joins.annotate_overlaps(points, y.where("b = 9").union(spark.createDataFrame([("c", 5, 5, "m")], y.schema)), "k", "p", ("a", "b"), "l")
    assert {r.k: (r.labels, r.covered) for r in found.collect()} == {"c": ("m", True), "d": ("", False), None: ("", False)}


def test_overlap_totals(spark):
    """Numbers and sums by brute force: touching ends, many tiles, negative and turned ranges, nulls and repeated rows."""
    rng = random.Random(8)
    place = lambda: rng.choice([None, *(rng.randrange(-300_000, 300_000) for _ in range(20))])
    span = lambda: (p := place(), None if p is None else p + rng.choice([0, 1, 300, 5000, 400_000, -1, -700]))
    key = lambda: rng.choice(["c", "d", None])
    left, right = [(i, key(), "+", *span()) for i in range(120)], [(rng.choice([None, j, 10**17]), key(), rng.choice("+-"), *span()) for j in range(120)]
    right += [(7, "c", "+", left[0][4] or 0, (left[0][4] or 0) + 1), (9, "e", "+", 0, 5), (None, "f", "+", 0, 5)]
    left += [left[0], left[1], (500, "e", "+", 5, 9), (501, "e", "+", 6, 9), (502, "f", "+", 5, 5)]
    x, y = spark.createDataFrame(left, "i long, k string, s string, a long, b long"), spark.createDataFrame(right, "v long, k string, s string, c long, d long")
    for p, r in ((left, right), ([z for z in left if z[3] is not None and z[3] <= z[4]], [z for z in right if z[3] is not None and z[3] <= z[4]])):
        want = []
        for i, k, s, a, b in p:
            hits = [v for v, k2, s2, c, d in r if None not in (k, a, c) and (k, s) == (k2, s2) and a <= d and c <= b]
            want += [(i, len(hits), sum(known) if (known := [v for v in hits if v is not None]) else None)] if hits else []
        x, y = spark.createDataFrame(p, x.schema), spark.createDataFrame(r, y.schema)
        got = joins.overlap_totals(x, y, ["k", "s"], ("a", "b"), ("c", "d"), "v").collect()
        assert Counter((g.i, g.n, g.total) for g in got) == Counter(want)


def test_interval_overlaps_of_deep_tables(spark, tmp_path):
    """Many points and genes at few places, nulls, repeated keys and turned ranges, as in SQL; nothing is broadcast by the size of files."""
    rng = random.Random(9)
    points = [(rng.choice([None, 25 * rng.randrange(-4, 4) + 1, 10_000 * i + 1]),) for i in range(400)]
    genes = [(rng.choice([None, i, i % 7]), rng.choice(["Brand#2", "Brand#2", "Brand#3", None]), rng.choice([None, 50, 1, 0, -1, -3])) for i in range(400)]
    spark.createDataFrame(points, "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(genes, "p_partkey long, p_brand string, p_size int").withColumn("p_type", F.lit("t")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found, want = queries.QUERIES["interval_overlaps"](spark, str(tmp_path)), con.sql(queries.ORACLE["interval_overlaps"]).to_arrow_table()
    assert want.num_rows > 100 and rows(found.toArrow()) == rows(want)
    assert "Broadcast" not in queries.QUERIES["interval_overlaps"](spark, D)._jdf.queryExecution().executedPlan().toString()


def test_cellranger_reads_at_any_size(spark, monkeypatch):
    """Genes beyond the bound are not broadcast, however small their file; reads of one id on two strands count apart, as in SQL."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 50)
    assert "Broadcast" not in queries.QUERIES["cellranger_reads"](spark, D)._jdf.queryExecution().executedPlan().toString()
    genes = spark.createDataFrame([("c", 1, "g1", 0, 99, "+"), ("c", 2, "g2", 50, 99, "-"), ("c", 3, "g3", 90, 99, "-")], "contig string, gid long, gene_id string, g_lft long, g_rgt long, strand string")
    made = [(5, 10, 60, False), (5, 10, 60, True), (6, 10, 90, True), (7, 10, 60, False), (7, 200, 300, False), (8, 10, 60, False), (8, 20, 70, False)]
    found = reads.cellranger_reads(spark.createDataFrame([(i, "c", a, b, r, 255, "B", "U", "N", 0, None) for i, a, b, r in made], "id long, contig string, lft long, rgt long, reverse boolean, mapq int, CB string, UB string, RE string, MM int, GX string"), genes)
    assert sorted((r.id, r.XS, r.gid) for r in found.collect()) == [(5, "+", 1), (5, "-", 2), (7, "+", 1)]


def test_mixed_molecule(spark):
    """One intronic read makes a molecule intronic; its reads and duplicates count apart; reads of bad UMIs count as discarded."""
    tags = spark.createDataFrame([(1, 5, 0, 10, False), (1, 5, 0, 10, True), (1, 5, 0, 11, False), (1, 5, 9, 3, False), (1, 5, 9, 3, False), (1, 6, 9, 3, False)], "barcode long, gene long, umi long, pos int, intronic boolean")
    bad = spark.createDataFrame([(1, 6, 9)], "barcode long, gene long, umi long")
    got = {r.gene: tuple(r)[2:] for r in quant.molecules(tags, bad).collect()}
    assert got == {5: (1, 2, 1, 1, 3, 1, 0), 6: (0, 0, 0, 0, 0, 0, 1)}
    r = quant.barcode_rates(quant.molecules(tags, bad)).first()
    assert (r.molecules, r.genes, r.pcr_dups, r.reads, r.intron_molecules, r.intron_pcr_dups, r.intron_reads, r.discarded_reads) == (1, 1, 1, 2, 1, 1, 3, 1)
    assert quant.correct_umis(quant.umi_nodes(tags.limit(0))).count() == 0


def test_rescored_and_projected(spark):
    hits = spark.createDataFrame([("2S4M1D2M3N2M", "GGACGTACNN", "ACGAxAC---GT"), ("3M2I1M", "ACGTTA", "ACGA")], "cigar string, seq string, ref string")
    assert [(r.score, r.nm) for r in reads.rescored(hits).collect()] == [(3 - 4 - 7 + 2 - 8, 4), (4 - 6 - 2, 2)]
    tx = spark.createDataFrame([("t", "c", "+", [(10, 19), (30, 39)]), ("u", "c", "-", [(10, 19), (30, 39)])], "transcript string, chrom string, strand string, exons array<struct<lft:int,rgt:int>>")
    h = spark.createDataFrame([("t", 5, 14), ("u", 0, 11), ("u", 12, 13)], "transcript string, t_lft int, t_rgt int")
    got = [(r.transcript, r.cigar) for r in reads.projected(h, tx).withColumn("cigar", reads.blocks_cigar()).orderBy("transcript", "t_lft").collect()]
    assert got == [("t", "5M10N5M"), ("u", "2M10N10M"), ("u", "2M")]


def test_ambient(spark):
    m = spark.range(4000).select(F.col("id").alias("molecule"), (F.col("id") % 4).alias("cell"))
    x = reads.reassign_ambient(m, 4, 0.2).cache()
    assert 650 < x.where("cell <> to_cell").count() < 950 and x.where("to_cell not between 0 and 3").count() == 0
    total = reads.mixture_counts(x).agg(F.sum("kept"), F.sum("ambient"), F.sum("lost")).first()
    assert total[0] + total[1] == 4000 and total[1] == total[2]


def test_call_cells(spark):
    good = [(f"b{i}", 800 + i, 2000 + 3 * i, 5.0, 40.0 + i % 3, 60.0, 1.0) for i in range(30)]
    odd = [("few", 10, 20, 5.0, 40.0, 60.0, 1.0), ("mt", 900, 2000, 60.0, 40.0, 60.0, 1.0), ("dup", 900, 2000, 5.0, 1.0, 60.0, 1.0), ("sat", 900, 2000, 5.0, 40.0, 5.0, 1.0), ("cor", 900, 2000, 5.0, 40.0, 60.0, 9.0)]
    rates = spark.createDataFrame(good + odd, "barcode string, molecules long, reads long, mt_percent double, dup_percent double, saturation double, corrected_percent double")
    assert {r.barcode for r in cells.call_cells(rates).collect()} == {g[0] for g in good}


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("chrom\tpos\tref\talt\nc1\t5\tA\tGT\n\nzz\t6\tA\tC\nc2\t7\tA\tT\n")
    contigs = spark.createDataFrame([(0, "c1"), (1, "c2")], "tid int, name string")
    targets, missing = readers.pileup_targets(spark, str(tmp_path / "t.txt"), contigs)
    assert sorted(map(tuple, targets.collect())) == [(0, 5, "G"), (1, 7, "T")] and [r.name for r in missing.collect()] == ["zz"]
    assert [r.line for r in readers.accuracy_list(spark, str(tmp_path / "t.txt")).where("pos = 6").collect()] == ["zz\t6\tA\tC"]
    f = spark.createDataFrame([("d", "a"), ("d", "b")], "dir string, file string")
    assert {r.file: r.total for r in readers.with_totals(f, spark.createDataFrame([("d", "a", "7")], "dir string, file string, total string")).collect()} == {"a": 7, "b": 0}
    r1 = spark.createDataFrame([(0, "x", "A" * 26, "F" * 26), (1, "y", "C" * 26, "F" * 26)], "rec long, name string, seq string, qual string")
    assert readers.reads_10x(r1, r1).count() == 2
    with pytest.raises(Exception, match="one of R1 and R2"):
        readers.reads_10x(r1, r1.where("rec = 0")).collect()


def test_sinks(spark, tmp_path):
    p = str(tmp_path)
    tx = spark.createDataFrame([("t", "c", [(10, 19), (130, 239)]), ("s", "c", [(1, 9)])], "transcript string, chrom string, exons array<struct<lft:int,rgt:int>>")
    lengths = spark.createDataFrame([(0, "c", 500)], "tid int, name string, length int")
    sinks.index_tables(f"{p}/index", tx.select("transcript"), tx, lengths)
    again = readers.index_transcripts(spark, f"{p}/index")
    assert sorted(map(str, again.select(*tx.columns).collect())) == sorted(map(str, tx.collect())) and readers.length_filter(again).count() == 1
    sinks.fasta(spark.createDataFrame([("n", "ACGT" * 40)], "name string, seq string"), f"{p}/x.fa")
    assert [(r.name, r.seq) for r in readers.fasta(spark, f"{p}/x.fa").collect()] == [("n", "ACGT" * 40)]
    counts = spark.createDataFrame([(1, 5, 2, 0), (1, 6, 0, 3)], "barcode long, gene long, molecules long, intronic long")
    sinks.quant_summary(f"{p}/q", spark.createDataFrame([(1, 2)], "barcode long, molecules long"), counts)
    assert spark.read.parquet(f"{p}/q/intronic").collect()[0]["count"] == 3
    snvs = spark.createDataFrame([(1, "c", 3, True), (2, "c", 1, False)], "snv long, chrom string, pos int, ok boolean")
    sinks.annotated(f"{p}/a", snvs, "ok", spark.createDataFrame([("passed", 1)], "reason string, count long"))
    snvs.select("snv", F.lit(7).alias("barcode")).write.parquet(f"{p}/a/calls")
    stored, calls = readers.sample_data(spark, f"{p}/a", spark.createDataFrame([(8,)], "barcode int"))
    assert stored.count() == 2 and calls.count() == 0 and readers.tsv(spark, f"{p}/a_passed_snvs.txt.gz").first().pos == "3"
    m = spark.createDataFrame([(0, 0, 2), (1, 1, 5)], "row long, col long, value long")
    sinks.dense_csv(m, ["b1", "b2"], f"{p}/m.csv")
    assert [tuple(r) for r in spark.read.option("header", "true").csv(f"{p}/m.csv").orderBy("row").collect()] == [("0", "2", "0"), ("1", "0", "5")]
    sinks.accuracy(snvs.select("chrom", "pos", F.col("snv").alias("n")), "x", f"{p}/acc/run_x.txt.gz")
    sinks.barcode_matrices(spark.createDataFrame([(0, 1, 2, 3, 4, 5)], "tid int, pos int, barcode int, base int, plus int, minus int"), lengths, f"{p}/b")
    assert spark.read.parquet(f"{p}/b/bases").first().base == 3
    places = spark.createDataFrame([("c", 5, [("d", "-", 7, "9M", 1)]), ("c", 2, [])], "chrom string, pos int, places array<struct<chrom:string,strand:string,pos:int,cigar:string,nm:int>>")
    sinks.alignments(places, f"{p}/reads")
    assert [(r.pos, r.XA) for r in spark.read.parquet(f"{p}/reads").collect()] == [(2, ""), (5, "d,-8,9M,1")]
