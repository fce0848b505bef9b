"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on full shingle sets.

Signature: 66 MinHash values of 16 bits, of a document's distinct shingles.  It is split into 11 chunks of 6 symbols.  By
pigeonhole, two signatures that differ in at most 11 * 2 - 1 = 21 symbols agree in some chunk but for at most one symbol;
so every chunk is indexed six times, each time with another symbol left out (all the errors allowed there), and all pairs
within 21 meet in a bucket.  Pairs that meet at up to ``REACH`` differences go on as well: at similarity 0.8 a pair
meets with probability 1 - 8e-6.  Links are confirmed on the full sets, so that none is false.

Buckets are never expanded into all pairs.  Texts with equal sets are one node.  A first round takes whole chunks as keys:
each bucket compares its members with one pivot by their signatures, and members that are near hang together from then on, so
that most near copies melt before the full index is made.  Of that, only buckets whose members don't all hang together are
kept.  Their members are dealt into blocks of 256 and compared by signatures within each block.  In buckets of several blocks
that still don't hang together, the members outside the largest part then meet all blocks, so that every pair that meets
within ``REACH`` ends in one loose group.

Loose groups are then compared exactly, on full sets as the rows of a 0/1 matrix whose product has all the intersections.
First one block of 256 texts meets every block of its group; what is linked by then needs no further links.  Then the texts
outside the largest part of a group meet all of the group, block by block, so that no pair of unlinked texts is left out.

A block pair sends on links between parts that did not hang together before, a tree of them, never pairs of members.  Sides
of joins that a hot bucket or group may dominate are written first, so that Spark can split the other side of such a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, prepare, sift, tasks_for
from .textvec import U, Words, mix, slices

CHUNKS, WIDTH = 11, 6
SYMBOLS = CHUNKS * WIDTH
#: Signature distances up to this many symbols make a loose link (at similarity 0.8, 5 sigma above the mean).
REACH = 30
_RNG = np.random.default_rng(20240501)
_XOR = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
FEATURES = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig binary"


def shingle_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of each k-word shingle, rows in order; of a row with fewer words, the whole sequence as one."""
    n = len(w.hash)
    acc, power = np.zeros(n, U), 1
    span = np.minimum(k, w.count)
    left = span[w.row_of] if n else span[:0]
    for i in range(k):
        part = np.zeros(n, U)
        if n > i:
            part[: n - i] = w.hash[i:]
        acc += np.where(left > i, part, U(i + 1)) * U(power)
        power = power * 0x9FB21C651E98DF25 % (1 << 64)
    keep = np.arange(n) - w.first[w.row_of] <= (w.count - span)[w.row_of] if n else np.zeros(0, bool)
    return w.row_of[keep], mix(acc[keep])


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                rows = len(offsets) - 1
                row, x = shingle_hashes(Words(data, offsets, lower=True), k)
                order = np.lexsort((x, row))
                row, x = row[order], x[order]
                new = np.ones(len(x), bool)
                new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1])
                row, x = row[new], x[new]
                count = np.bincount(row, minlength=rows)
                full = np.flatnonzero(count)
                first = np.searchsorted(row, full)
                f1, f2, sig = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [b""] * rows
                if len(full):
                    f1[full] = np.add.reduceat(x, first).view(np.int64)
                    f2[full] = np.add.reduceat(mix(x ^ U(0xA0761D6478BD642F)), first).view(np.int64)
                    low, mins = (x >> U(32)).astype(np.uint32), np.empty((len(full), SYMBOLS), np.uint16)
                    for i in range(SYMBOLS):
                        h = (low ^ _XOR[i]) * _MUL[i]
                        h ^= h >> np.uint32(15)
                        h *= np.uint32(0x2C1B3C6D)
                        m = np.minimum.reduceat(h, first)
                        mins[:, i] = ((m ^ (m >> np.uint32(16))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
                    raw = mins.tobytes()
                    for j, r in enumerate(full.tolist()):
                        sig[r] = raw[j * 2 * SYMBOLS : (j + 1) * 2 * SYMBOLS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(count, pa.int64()), pa.array(f1), pa.array(f2), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sig"])

    return run


def _index(errors: bool):
    """Index keys of a signature: its 11 chunks, or (with errors) each chunk with one symbol left out, 66 in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(U)
            powers = mix(np.arange(1, 1 + SYMBOLS, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(CHUNKS, WIDTH) | U(1)
            parts = mix(sig + powers) * powers
            total = parts.sum(2)
            keys = mix(total[:, :, None] - parts + powers if errors else total).reshape(-1)
            each = SYMBOLS if errors else CHUNKS
            rest = (pa.array(np.repeat(batch.column(i).to_numpy(), each)) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *rest], ["key", "rep", "n", "comp"])

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
        near = pa.array((a != b).sum(1) <= REACH)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])


def _tree(comps: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between components (comps: that of each member) that a symmetric matrix of linked members joins: a tree of them."""
    kinds, of = np.unique(comps, return_inverse=True)
    u, v = np.nonzero(linked)
    joined = np.zeros((len(kinds), len(kinds)), bool)
    joined[of[u], of[v]] = True
    label = least_reachable(joined)
    far = label != np.arange(len(label))
    return kinds[label[far]], kinds[far]


def _meet(percent: int):
    """Rows (key, i, j, comp, n, sig) sorted by (key, i, j): the members of one block pair of a bucket after another."""

    def settle(comps: list[int], sizes: list[int], sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array(sizes)
        raw = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SYMBOLS)
        differ = np.zeros((len(n), len(n)), np.int16)
        for symbols in np.array_split(raw.T, SYMBOLS if len(n) > 64 else 1):
            differ += (symbols[:, :, None] != symbols[:, None, :]).sum(0, dtype=np.int16)
        linked = (differ <= REACH) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
        return _tree(np.array(comps), linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 2]
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for *at, comp, n, sig in zip(*columns, strict=True):
                if at != now:
                    if len(set(held[0])) > 1:
                        found.append(settle(*held))
                    now, held = at, ([], [], [])
                for to, x in zip(held, (comp, n, sig), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
        if len(set(held[0])) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in settle(*held)], ["a", "b"])

    return run


def shingle_set(text: str | None, k: int) -> set:
    """The set of a text, as tuples of words; near_duplicates links by fingerprints of these."""
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} - {()}


#: Rows of the index that a task makes.
INDEX_ROWS = 500_000
#: Texts in a block of the exact comparison.
BLOCK = 256


def links_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets (arrays of distinct fingerprints) have similarity >= percent / 100: a symmetric boolean matrix."""
    size = np.array([len(x) for x in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    pick = shared[column]
    row, column = row[pick], number[column[pick]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    step = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        x = np.zeros((len(sets), step), np.float32)
        x[row[a:b], column[a:b] - n * step] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    return (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both))


def least_reachable(linked: np.ndarray) -> np.ndarray:
    """Index of the first row reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _exact(k: int, percent: int):
    """Rows (g, i, j, part, text) sorted by (g, i, j): the texts of one block pair after another."""

    def settle(parts: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _tree(np.array(parts), links_within(sets, percent))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, sets = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            ids = batch.column(3).to_pylist()
            for first, data, offsets in slices(batch.column(4)):
                row, x = shingle_hashes(Words(data, offsets, lower=True), k)
                cuts = np.searchsorted(row, np.arange(len(offsets)))
                for r in range(len(offsets) - 1):
                    if keys[first + r] != now:
                        if len(set(parts)) > 1:
                            yield settle(parts, sets)
                        now, parts, sets = keys[first + r], [], []
                    parts.append(ids[first + r])
                    sets.append(np.unique(x[cuts[r] : cuts[r + 1]]))
        if len(set(parts)) > 1:
            yield settle(parts, sets)

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, linking sets with similarity >= percent / 100.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document with fewer words than a shingle has
    its whole sequence as its one shingle.  Null or blank text: an empty set, linked with nothing, a component of its own.
    Rows without an id are kept and stand for no component.  Repeated rows (the same id and text) stay rows and share their id's component; other columns are not read.  An empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = cut(slim.mapInArrow(_features(shingle), FEATURES))
    reps = cut(features.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")).where("rep is not null"))
    sigs, index = reps.select("rep", "sig"), "key bigint, rep bigint, n bigint, comp bigint"
    ratio = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")

    def with_pivots(placed: DataFrame) -> DataFrame:
        """Pairs of each member of a bucket with one of its members."""
        pivot = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n", "comp")).alias("p"), F.min("comp").alias("c"), F.max("comp").alias("d"))
        pairs = placed.join(cut(pivot.where("c <> d").select("key", "p")), "key").select("rep", "n", "comp", F.col("p.rep").alias("b"), F.col("p.n").alias("m"), F.col("p.comp").alias("comp_b"))
        return pairs.where("comp <> comp_b").where(ratio).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))

    def close(pairs: DataFrame) -> DataFrame:
        signed = pairs.distinct().join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
        return cut(signed.mapInArrow(_close, "a bigint, b bigint"))

    def located(rows: DataFrame, loose: DataFrame) -> DataFrame:
        """Rows with the loose component of rep as comp."""
        return rows.join(loose, rows.rep == loose.node, "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")

    def blocks_of(n: str, word: str) -> Column:
        return F.expr(f"cast(pmod(xxhash64({word}), {n}) as int)")

    def dealt_anew(rows: DataFrame, key: str, word: str, comp: str) -> DataFrame:
        """Rows of the buckets or groups whose members are of several parts: those outside the largest part are in the blocks
        0 to first - 1, the others in the blocks behind them; the blocks that a row meets are exploded as o."""
        most = rows.groupBy(key, comp).agg(F.count("*").alias("c")).groupBy(key).agg(F.max(F.struct("c", comp)).alias("top"), F.sum("c").alias("every")).where("top.c < every")
        most = cut(most.select(key, F.col(f"top.{comp}").alias("main"), F.expr(f"cast(ceil((every - top.c) / {BLOCK}) as int)").alias("first"), F.expr(f"cast(ceil(top.c / {BLOCK}) as int)").alias("others")))
        placed = rows.join(most, key).withColumn("at", F.when(F.col(comp) == F.col("main"), F.col("first") + blocks_of("others", word)).otherwise(blocks_of("first", word)))
        return placed.withColumn("o", F.explode(F.expr("sequence(0, if(at < first, first + others, first) - 1)")))

    slots = reps.select("rep", F.col("n_shingles").alias("n"), F.col("rep").alias("comp"), "sig")
    near = close(with_pivots(slots.mapInArrow(_index(False), index)))
    loose = connected_components(near)
    # As many tasks as index rows need, so that what a task merges before its shuffle stays small.
    indexed = located(slots.drop("comp"), loose).select("rep", "n", "comp", "sig").repartition(reps.count() * SYMBOLS // INDEX_ROWS + 1)
    keys = indexed.mapInArrow(_index(True), index)
    open_ = cut(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("key", "members"))
    buckets = cut(keys.join(open_, "key").select("key", "rep", "n", "comp", "members"))
    rows = buckets.count()

    def meet(placed: DataFrame) -> DataFrame:
        signed = placed.join(sigs, "rep").select("key", "i", "j", "comp", "n", "sig")
        return cut(signed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_meet(percent), "a bigint, b bigint").distinct())

    if rows:
        buckets = buckets.coalesce(tasks_for(rows))
        near = near.unionByName(meet(buckets.withColumn("i", blocks_of(f"ceil(members / {BLOCK})", "rep")).withColumn("j", F.col("i"))))
        loose = connected_components(near)
        wide = located(buckets.where(f"members > {BLOCK}").drop("comp"), loose)
        found = meet(dealt_anew(wide, "key", "rep", "comp").withColumn("i", F.least("at", "o")).withColumn("j", F.greatest("at", "o")))
        if not found.isEmpty():
            near = near.unionByName(found)
            loose = connected_components(near)
    member = cut(loose.select(F.col("node").alias("doc_id"), F.col("component").alias("g")))

    def compared(dealt: DataFrame) -> DataFrame:
        """Links between the parts of a group whose texts share a block pair; dealt: doc_id, g, part, at, o."""
        pairs = sift(slim, dealt.select("doc_id"), "doc_id").join(dealt, "doc_id").select("g", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "part", "text")
        return cut(pairs.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_exact(shingle, percent), "a bigint, b bigint"))

    size = cut(member.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = member.join(size, "g", "left").select("doc_id", "g", F.col("doc_id").alias("part"), F.coalesce(blocks_of("blocks", "doc_id"), F.lit(0)).alias("at"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    links = compared(dealt.withColumn("o", F.explode(F.expr("sequence(0, if(at < 1, blocks, 1) - 1)"))))
    # Groups of one block have met themselves in full.
    parts = cut(connected_components(links).toDF("doc_id", "part"))
    part = member.join(parts, "doc_id", "left").select("doc_id", "g", F.coalesce("part", "doc_id").alias("part"))
    part = cut(part.join(size.select("g"), "g"))
    if not part.isEmpty():
        links = links.unionByName(compared(cut(dealt_anew(part, "g", "doc_id", "part"))))
    comp = connected_components(links)
    out = features.join(reps.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"], "left")
    out = out.join(comp, out.rep == comp.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))
