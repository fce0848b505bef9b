"""Column functions over DNA strings, codes, CIGAR strings and names; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_dna(seq: Column | str) -> Column:
    return _c(seq).rlike("^[ACGT]+$")


def encode(seq: Column | str, all_a_invalid: bool = False) -> Column:
    """2-bit code, first base most significant; null if a letter is not one of ACGT.  all_a_invalid: code 0 is null too."""
    digits = F.transform(F.split(F.translate(_c(seq), BASES, "0123"), ""), lambda d: d.cast("bigint"))
    code = F.when(valid_dna(seq), F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 4 + F.coalesce(d, F.lit(0))))
    return F.when(code != 0, code) if all_a_invalid else code


def decode(code: Column | str, n: int) -> Column:
    """The n bases of a 2-bit code."""
    return F.concat(*(F.substring(F.lit(BASES), F.shiftright(_c(code), 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for i in range(n - 1, -1, -1)))


def homopolymer(seq: Column | str) -> Column:
    return _c(seq).rlike(r"^(.)\1*$")


def valid_umi(seq: Column | str) -> Column:
    return valid_dna(seq) & ~homopolymer(seq)


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_c(seq)), "ACGTUNRYSWKMBDHVacgtn", "TGCAANYRSWMKVHDBtgcan")


def complement(base: Column | str) -> Column:
    return F.translate(_c(base), "ACGT", "TGCA")


def trim_tail(seq: Column | str, base: str = "A", least: int = 6) -> Column:
    """Length kept once a tail of base is stripped (all of it if fewer than least are); null if over half is stripped."""
    full = F.length(_c(seq))
    cut = full - F.length(F.regexp_replace(_c(seq), f"{base}+$", ""))
    return F.when(cut < least, full).when(cut * 2 <= full, full - cut)


def dust(seq: Column | str) -> Column:
    """Low-complexity score: sum of c (c - 1) / 2 over triplet counts by the number of triplets; null with fewer than 3 bases."""
    s = _c(seq)
    at = F.sort_array(F.regexp_extract_all(s, F.lit("(?s)(?=(...))"), F.lit(1)))
    # A triplet adds the equal ones before it, which sorting puts next to it: one pass, whatever the length.
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("same"), F.lit(0.0).alias("pairs"))

    def step(a: Column, x: Column) -> Column:
        same = F.when(a["last"] == x, a["same"] + 1).otherwise(0.0)
        return F.struct(x.alias("last"), same.alias("same"), (a["pairs"] + same).alias("pairs"))

    pairs = F.aggregate(at, start, step, lambda a: a["pairs"])
    return F.when(F.length(s) >= 3, pairs / (F.length(s) - 2))


def hamming1_codes(code: Column | str, n: int) -> Column:
    """Array of (i, code) of the 3 n codes that differ in one base; i: index of that base from the last one."""
    c = _c(code)
    one = [F.struct(F.lit(i).alias("i"), c.bitwiseXOR(F.lit(x << (2 * i)).cast("bigint")).alias("code")) for i in range(n) for x in (1, 2, 3)]
    return F.array(*one)


def is_hamming1(a: Column | str, b: Column | str, n: int) -> Column:
    x = _c(a).bitwiseXOR(_c(b))
    mask = sum(1 << (2 * i) for i in range(n))
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(mask).cast("bigint"))) == 1


def phred(qual: Column | str) -> Column:
    return F.transform(F.split(_c(qual), ""), lambda q: F.ascii(q) - 33)


def strip_suffix(barcode: Column | str) -> Column:
    return F.substring_index(_c(barcode), "-", 1)


def pack_position(start: Column | str, end: Column | str) -> Column:
    return F.shiftleft(_c(start).cast("bigint"), 32).bitwiseOR(_c(end).cast("bigint"))


def substitution(ref: Column | str, alt: Column | str) -> Column:
    return F.concat(_c(ref), F.lit(">"), _c(alt))


def is_transition(ref: Column | str, alt: Column | str) -> Column:
    return substitution(ref, alt).isin("A>G", "G>A", "C>T", "T>C")


def cigar_ops(cigar: Column | str) -> Column:
    """Array of (len, op) of a CIGAR string."""
    parts = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\d+", 0).cast("int").alias("len"), F.substring(p, -1, 1).alias("op")))


def reference_bases(cigar: Column | str) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def clipped_bases(cigar: Column | str) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda a, x: a + F.when(x["op"].isin("S", "H"), x["len"]).otherwise(0))


def skip_deletion_skip(cigar: Column | str) -> Column:
    """Whether a skip, a deletion and a skip follow each other."""
    return _c(cigar).rlike(r"N\d+D\d+N")


def natural_key(name: Column | str, width: int = 12) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(_c(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")
