"""Operators on hand fixtures, and registered queries against DuckDB."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellweave.functions import dna
from cellweave.operators import joins, pileup, quant, sessionize, snv
from cellweave.plans import queries
from cellweave.session import TABLES
from cellweave.sources import readers, sinks

D = "/root/testdata/sf0.001"


def norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(round(float(v), 6) if isinstance(v, float) else (None if v is None or v != v else str(v).removesuffix(".0")) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["umi_components", "multi_gene_umis", "interval_overlaps", "nearest_sites", "snv_candidates", "consensus_bases", "merge_tools", "cell_ranks", "session_windows"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    key = lambda r: tuple(map(str, r))
    a, b = queries.QUERIES[name](spark, D).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(norm(a), key=key) == sorted(norm(b), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_dna(spark):
    r = spark.createDataFrame([("ACGTN", "AAAA")], "s string, h string").select(
        dna.reverse_complement("s").alias("rc"), dna.encode("h").alias("a"), dna.encode("h", all_a_invalid=True).alias("b"), dna.valid_umi("h").alias("u"), dna.encode("s").alias("n"),
        dna.skip_deletion_skip(F.lit("5M2N3D2N5M")).alias("ndn"), dna.reference_bases(F.lit("5M2I3D2N5M")).alias("ref"), dna.dust(F.lit("AAAAA")).alias("dust"),
    ).first()
    assert (r.rc, r.a, r.b, r.u, r.n, r.ndn, r.ref, r.dust) == ("NACGT", 0, None, False, None, True, 15, 1.0)


def test_umi_graph(spark):
    # 10-1-1 star, and two apart at two substitutions; ties go to the least code
    nodes = spark.createDataFrame([(1, 1, 0, 10), (1, 1, 1, 1), (1, 1, 4, 1), (1, 1, 0b101010, 3), (1, 1, 0b101011, 3)], "barcode long, gene long, umi long, cnt long")
    got = {r.umi: r.umi_to for r in quant.correct_umis(nodes).collect()}
    assert got == {0: 0, 1: 0, 4: 0, 42: 42, 43: 43}


def test_multi_gene(spark):
    n = spark.createDataFrame([(1, 1, 5, 3), (1, 2, 5, 1), (1, 1, 6, 2), (1, 2, 6, 2)], "barcode long, gene long, umi long, cnt long")
    assert sorted((r.gene, r.umi) for r in quant.multi_gene_umis(n).collect()) == [(1, 6), (2, 5), (2, 6)]


def test_barcode_ties(spark):
    w = spark.createDataFrame([(0b0001, 5), (0b0100, 5), (0b1100, 0)], "code long, cnt long")
    o = spark.createDataFrame([(0b0000,), (0b1100,), (0b1111,)], "code long")
    got = {r.code: (r.status, r.corrected) for r in joins.correct_barcodes(o, w, 2).collect()}
    assert got == {0: (2, 1), 12: (0, 12), 15: (1, None)}


def test_aligned_bases(spark):
    r = spark.createDataFrame([(0, 10, "1S2M1I1M1D1M", "TACGGT", "IIIIII")], "tid int, pos int, cigar string, seq string, qual string")
    got = sorted((x.rpos, x.qpos, x.base) for x in pileup.aligned_bases(r).collect())
    assert got == [(10, 1, "A"), (11, 2, "C"), (12, 4, "G"), (14, 5, "T")]


def test_sessions_and_empty(spark):
    x = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 11, 12)], "k int, lft int, rgt int")
    blocks = sessionize.merged_blocks(x, ["k"], "lft", "rgt")
    assert [(r.lft, r.rgt) for r in blocks.orderBy("lft").collect()] == [(0, 9), (11, 12)]
    assert [(r.lft, r.rgt) for r in sessionize.block_gaps(blocks, ["k"]).collect()] == [(10, 10)]
    assert sessionize.merged_blocks(x.limit(0), ["k"], "lft", "rgt").count() == 0


def test_region_priority_and_groups(spark):
    p = spark.createDataFrame([(1, 1), (1, 2)], "tid int, pos int")
    o = spark.createDataFrame([(1, 1, "I"), (1, 1, "E")], "tid int, pos int, region_kind string")
    assert {r.pos: r.region for r in pileup.region_labels(p, o).collect()} == {1: "E", 2: "-"}
    with pytest.raises(KeyError):
        snv.GroupBuilder().add_group("x", "x", "unknown")


def test_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 c\nACGTACGTACGTACGTAAAACCCCGG\n+\n" + "I" * 26 + "\n@r2\nACGT\n+\nIIII\n")
    r = readers.fastq(spark, str(tmp_path / "a.fastq")).orderBy("rec").collect()
    assert [(x.name, x.comment, x.seq[:4]) for x in r] == [("r1", "c", "ACGT"), ("r2", "", "ACGT")]
    m = spark.createDataFrame([(0, 1, 3), (2, 0, 4), (1, 1, 0)], "row long, col long, value long")
    sinks.matrix_market(m, str(tmp_path / "m"), 3, 2)
    back = readers.matrix_market(spark, str(tmp_path / "m"))
    assert sorted(tuple(x) for x in back.collect()) == [(0, 1, 3.0), (2, 0, 4.0)]
    (tmp_path / "g.gtf").write_text('1\tx\texon\t101\t200\t.\t+\t.\tgene_id "G"; transcript_id "T";\n1\tx\texon\t301\t400\t.\t+\t.\tgene_id "G"; transcript_id "T";\n')
    t = readers.transcripts(readers.gtf(spark, str(tmp_path / "g.gtf"))).first()
    assert (t.lft, t.rgt, len(t.exons), t.coding_start) == (100, 399, 2, None)


def test_sequence_functions_whole_texts(spark, tmp_path):
    """Texts of over 40 bases by brute force: tails and triplets at the far end count."""
    rng = random.Random(4)
    texts = ["ACGT" * 20 + "A" * 9, "C" * 50 + "A" * 51, "".join(rng.choices("ACGTacgtNxyz \n", k=3000)), "A" * 500, "ac", "", None, "GATTACA"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["sequence_functions"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert (got[i].s, got[i].rc, got[i].kept, got[i].dust) == (None, None, None, None)
            continue
        s = "".join(c for c in text.upper() if c in "ACGT")
        tail = len(s) - len(s.rstrip("A"))
        kept = len(s) if tail < 6 else len(s) - tail if 2 * tail <= len(s) else None
        counts = Counter(s[k : k + 3] for k in range(len(s) - 2))
        dust = sum(c * (c - 1) / 2 for c in counts.values()) / (len(s) - 2) if len(s) >= 3 else None
        assert (got[i].s, got[i].rc, got[i].kept) == (s, s[::-1].translate(str.maketrans("ACGT", "TGCA")), kept)
        assert got[i].dust == (None if dust is None else pytest.approx(dust))
