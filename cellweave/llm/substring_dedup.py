"""Repeated word windows by recompression.

Rounds of recompression turn a document's words into ever longer symbols: round one names runs of exactly two equal
words and pairs of neighbours, later rounds pairs; a pair is named if its left symbol's fingerprint falls on the left side
of the round's partition of the alphabet and its right symbol's on the right side.  A name is the fingerprint of what it
stands for, so all tasks give equal things equal names without exchanging a dictionary, and equal substrings are cut
alike in their interior.

With two rounds of known names a window of 20 words has at least one symbol border of round three that depends on the
window alone, 5 to 15 words from its start: names are lost for 2 words at each end in round one and 2 in round two, the
12 words left hold three symbols of at most four words, and round three removes one of two neighbouring borders at most.
Round-three borders, with the ten words around them, are the index (one for each 2.4 words); borders that occur again
reveal all repeats.  Only windows around those are compared, as a whole, by fingerprints of two independent polynomials (88 bits and
those of the bucket).

Index keys and places travel packed by bucket.  Every map task first settles what repeats within itself and sends on one row per name at most, so that no name is more
frequent after the shuffle than there are tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, partitions, prepare, sift
from .textvec import U, Words, mix, slices, window_hashes

WINDOW = 20
#: Words before and after a border that belong to its index key.
AROUND = 5
_SEEDS = [0x8CB92BA72F3D8DD7, 0xABCD9E3779B9AF17, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def _merge(names: np.ndarray, row: np.ndarray, gone: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names after the borders before the marked positions are taken away; positions kept."""
    at = np.flatnonzero(~gone)
    out = names[at].copy()
    nxt = np.append(at[1:], len(names)) - at == 2
    left = at[nxt]
    out[nxt] = mix(names[left] * U(_SEEDS[level] | 1) + mix(names[left + 1] ^ U(_SEEDS[level])))
    return out, at


def borders(names: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of words that begin a round-three symbol."""
    at = np.arange(len(names))
    for level in range(3):
        n = len(names)
        if n < 2:
            break
        next_ = np.zeros(n, bool)
        next_[:-1] = row[1:] == row[:-1]
        gone = np.zeros(n, bool)
        used = np.zeros(n, bool)
        if level == 0:  # runs of two
            same = np.zeros(n, bool)
            same[:-1] = next_[:-1] & (names[1:] == names[:-1])
            two = same.copy()
            two[1:] &= ~same[:-1]
            two[:-1] &= ~same[1:]
            gone[1:] = two[:-1]
            used = two | gone
        side = (mix(names + U(_SEEDS[level])) & U(1)).astype(bool)
        pair = np.zeros(n, bool)
        pair[:-1] = next_[:-1] & side[:-1] & ~side[1:] & ~used[:-1] & ~used[1:]
        gone[1:] |= pair[:-1]
        names, keep = _merge(names, row, gone, level)
        at, row = at[keep], row[keep]
    return at


#: Border keys or windows that a task settles at once (about 50 bytes each while they are sorted).
HELD = 1_000_000
#: Packed rows in one Arrow batch.
_PACKED_ROWS = 32
PACKED = "bucket int, single binary, other binary, base bigint, docs binary, places binary"
_COLS = ["bucket", "single", "other", "base", "docs", "places"]
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as they need, after a byte that tells how many."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _pack(doc: np.ndarray, place: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending document ids as differences, and places."""
    base = int(doc[0]) if len(doc) else 0
    return base, _narrow(np.diff(doc, prepend=base)), _narrow(place)


def _unpack(base: int, docs: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_wide(docs)) + base, _wide(places).astype(np.int32)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), _PACKED_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + _PACKED_ROWS], strict=True), _KINDS, strict=True)], _COLS)


def _deal(bits: int, top: np.ndarray, tail: np.ndarray, single: np.ndarray, doc: np.ndarray, place: np.ndarray, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows by bucket (the first bits of top): tails of single keys with their places, tails of other keys; then
    rows without keys, with the places that are settled.  All arrays are in the order of documents; settled is a mask, and
    neither single nor other keys are in it unless marked so."""
    bucket = (top >> U(64 - bits)).astype(np.int32)
    rows = []
    ones, more = np.flatnonzero(single == 1), np.flatnonzero(single == 2)
    ones, more = ones[np.argsort(bucket[ones], kind="stable")], more[np.argsort(bucket[more], kind="stable")]
    every = np.arange((1 << bits) + 1)
    cut1, cut2 = np.searchsorted(bucket[ones], every), np.searchsorted(bucket[more], every)
    for b in np.flatnonzero((np.diff(cut1) > 0) | (np.diff(cut2) > 0)).tolist():
        i, j = ones[cut1[b] : cut1[b + 1]], more[cut2[b] : cut2[b + 1]]
        rows.append((b, tail[i].tobytes(), tail[j].tobytes(), *_pack(doc[i], place[i])))
    yield from _batches(rows)
    at = np.flatnonzero(settled)
    rows = []
    for n, i in enumerate(range(0, len(at), 1 << 14)):
        part = at[i : i + (1 << 14)]
        rows.append(((n * 37 + int(doc[part[0]])) % (1 << bits), None, None, *_pack(doc[part], place[part])))
    yield from _batches(rows)


def _bytes_of(x: np.ndarray, first: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, first : first + n]


def _places(doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + 100_000]), pa.array(place[i : i + 100_000])], ["doc_id", "place"])


KEY_TAIL, WINDOW_TAIL = 6, 11


def _index(bits: int):
    """Border keys by bucket: a key's place if it is single here, else the bare key; places of keys that repeat here are settled."""

    def settle(keys: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
        key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        first = np.concatenate(([True], ~same))
        again = np.concatenate((same, [False])) | ~first
        kind, settled = np.zeros(len(key), np.int8), np.zeros(len(key), bool)
        kind[order] = np.where(first, np.where(again, 2, 1), 0)
        settled[order] = again
        by = np.argsort(doc, kind="stable") if (np.diff(doc) < 0).any() else slice(None)
        key, doc, place, kind, settled = key[by], doc[by], place[by], kind[by], settled[by]
        yield from _deal(bits, key, _bytes_of(key, bits // 8, KEY_TAIL), kind, doc, place, settled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, held = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets)
                if len(w.hash) < WINDOW:
                    continue
                at = borders(w.hash, w.row_of)
                inside = at - w.first[w.row_of[at]]
                ok = (inside >= AROUND) & (inside + AROUND <= w.count[w.row_of[at]])
                at = at[ok]
                if len(at):
                    keys.append(window_hashes(w.hash, 2 * AROUND)[at - AROUND])
                    docs.append(ids[first + w.row_of[at]].astype(np.int64))
                    places.append(inside[ok].astype(np.int32))
                    held += len(at)
                if held >= HELD:
                    yield from settle(keys, docs, places)
                    keys, docs, places, held = [], [], [], 0
        if keys:
            yield from settle(keys, docs, places)

    return run


def _after_first(same: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of sorted rows stand at a later place than the first of their key; same: whether a row has the key of the row before.

    Repeated rows of a document stand at the same place, of which none is later."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return (doc != doc[first]) | (place != place[first])


def _compare(tails: int, earliest: bool):
    """Settled places as they came, and those of compared rows whose key others have too: all of them, or all but the
    earliest (document, place) of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, single, other, base, docs, places in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if single is None:
                    yield from _places(*_unpack(base, docs, places))
                else:
                    held.setdefault(bucket, []).append((single, other, base, docs, places))
        while held:
            _, parts = held.popitem()
            known = [_unpack(*x[2:]) for x in parts]
            doc, place = np.concatenate([x[0] for x in known]), np.concatenate([x[1] for x in known])
            tail = np.frombuffer(b"".join([x[0] for x in parts] + [x[1] for x in parts]), np.uint8).reshape(-1, tails)
            wide = np.zeros((len(tail), 16), np.uint8)
            wide[:, :tails] = tail
            k1, k2 = (wide[:, i : i + 8].copy().view(np.uint64).reshape(-1) for i in (0, 8))
            bare = np.arange(len(tail)) >= len(doc)
            doc, place = np.append(doc, np.zeros(int(bare.sum()), np.int64)), np.append(place, np.zeros(int(bare.sum()), np.int32))
            order = np.lexsort((place, doc, bare, k2, k1)) if earliest else np.argsort(k1, kind="stable")
            same = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
            hit = np.concatenate(([False], same))
            hit = _after_first(hit, doc[order], place[order]) if earliest else hit | np.concatenate((same, [False]))
            hit = order[hit & ~bare[order]]
            yield from _places(doc[hit], place[hit])

    return run


def _windows(bits: int):
    """Fingerprints of the windows around the given borders, by bucket.  Each window sends its earliest place here; later
    places here are settled."""

    def settle(h1s: list, h2s: list, docs: list, starts: list) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, start = (np.concatenate(x) for x in (h1s, h2s, docs, starts))
        by = np.lexsort((start, doc))
        h1, h2, doc, start = h1[by], h2[by], doc[by], start[by]
        order = np.lexsort((h2, h1))  # stable: places ascend within a window
        same = np.concatenate(([False], (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])))
        later = np.zeros(len(h1), bool)
        later[order] = _after_first(same, doc[order], start[order])
        tail = np.hstack((_bytes_of(h1, bits // 8, 7), _bytes_of(h2, 0, WINDOW_TAIL - 7)))
        yield from _deal(bits, h1, tail, (~later).astype(np.int8), doc, start, later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1s, h2s, docs, starts, held = [], [], [], [], 0
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(2)
            for first, data, offsets in slices(batch.column(1)):
                w, rows = Words(data, offsets), len(offsets) - 1
                n = len(w.hash)
                if n < WINDOW:
                    continue
                part = marks.slice(first, rows)
                place = part.flatten().to_numpy()
                of = np.repeat(np.arange(rows), np.diff(part.offsets.to_numpy()))
                # a window is compared if it holds a marked border with all the words around it
                low = np.maximum(place + AROUND - WINDOW, 0) + w.first[of]
                high = np.minimum(place - AROUND, w.count[of] - WINDOW) + w.first[of]
                ok = high >= low
                cover = np.bincount(low[ok], minlength=n + 1)[: n + 1] - np.bincount(high[ok] + 1, minlength=n + 1)[: n + 1]
                at = np.flatnonzero(np.cumsum(cover[:n]) > 0)
                if len(at):
                    h1s.append(window_hashes(w.hash, WINDOW)[at])
                    h2s.append(window_hashes(mix(w.hash ^ U(0x94D049BB133111EB)), WINDOW, 0xD6E8FEB86659FD93)[at])
                    docs.append(ids[first + w.row_of[at]].astype(np.int64))
                    starts.append((at - w.first[w.row_of[at]]).astype(np.int32))
                    held += len(at)
                if held >= HELD:
                    yield from settle(h1s, h2s, docs, starts)
                    h1s, h2s, docs, starts, held = [], [], [], [], 0
        if h1s:
            yield from settle(h1s, h2s, docs, starts)

    return run


def _cut_words(digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, whole, flags in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if whole.as_py() and n >= WINDOW:
                    kept: list[bytes] = []
                elif flags.is_valid and len(flags.values):
                    cover = np.zeros(n + WINDOW + 1, np.int32)
                    start = flags.values.to_numpy()
                    start = start[start <= n - WINDOW]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + WINDOW, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()]
                else:
                    kept = words
                line = b" ".join(kept)
                digest = hashlib.sha256(line).hexdigest()
                full = digest if len(kept) == n else hashlib.sha256(b" ".join(words)).hexdigest()
                out.append((doc.as_py(), n, n - len(kept), digest, None if digest_only else line.decode(), full))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "full_sha256"])

    return run


def repeated_windows(docs: DataFrame, digest_only: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null with digest_only) of every document row.

    Removed is each word within a window of 20 words whose sequence also starts earlier: in a smaller doc_id, or earlier in
    the same document.  Windows are judged on the input.  Null and blank texts have no words; rows
    without an id keep all their words and are no earlier place; repeated rows (the same id and text) are one document, and each is cut
    like it; different texts of one id stand at the same places, and words that go from one go from the other.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Whole copies of an earlier text need no windows: all their words go.
    named = slim.where("doc_id is not null")
    body = named.select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n")).where("n > 0")
    first = body.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1")
    copies = hold(body.join(first, "h").where("doc_id > least").select("doc_id").distinct())
    bits = max(8, math.ceil(math.log2(4 * partitions(spark))))
    found = named.mapInArrow(_index(bits), PACKED).repartition(1 << bits, "bucket").mapInArrow(_compare(KEY_TAIL, False), "doc_id bigint, place int")
    marks = hold(found.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("places")).join(copies, "doc_id", "left_anti"))
    texts = sift(slim, marks.select("doc_id"), "doc_id").join(marks, "doc_id").select("doc_id", "text", "places")
    late = texts.mapInArrow(_windows(bits), PACKED).repartition(1 << bits, "bucket").mapInArrow(_compare(WINDOW_TAIL, True), "doc_id bigint, place int")
    flags = late.groupBy("doc_id").agg(F.collect_set("place").alias("flags")).withColumn("whole", F.lit(False))
    flags = hold(flags.unionByName(copies.select("doc_id", F.lit(None).cast("array<int>").alias("flags"), F.lit(True).alias("whole"))))
    shape = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, full_sha256 string"
    cutting = _cut_words(digest_only)
    hit = sift(slim, flags.select("doc_id"), "doc_id").join(flags, "doc_id").select("doc_id", "text", "whole", "flags").mapInArrow(cutting, shape)
    whole = slim.select("doc_id", "text", F.lit(False).alias("whole"), F.lit(None).cast("array<int>").alias("flags")).mapInArrow(cutting, shape)
    if not digest_only:
        whole = whole.join(flags.select("doc_id"), "doc_id", "left_anti")
        return whole.unionByName(hit).drop("full_sha256")
    late = hit.select("doc_id", "full_sha256", F.col("n_removed").alias("less"), F.col("kept_sha256").alias("left")).distinct()
    out = whole.join(late, ["doc_id", "full_sha256"], "left")
    return out.select("doc_id", "n_words", F.coalesce("less", "n_removed").alias("n_removed"), F.coalesce("left", "kept_sha256").alias("kept_sha256"))
