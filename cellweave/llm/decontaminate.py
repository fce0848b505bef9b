"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, each text scanned once.

Normalisation lower-cases A-Z, keeps runs of ASCII letters, digits and all other characters above ASCII as words, and
joins them by one space.  A window is 13 consecutive words of an item (the whole item if it has fewer).  All windows form
one automaton; a document's normalised text passes through it once, and hits are mapped back to words and to character
offsets of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

WINDOW = 13
#: The number of windows that one automaton holds on average (about 500 MB); a larger benchmark is scanned in blocks, one after another.
AUTOMATON_WINDOWS = 500_000
#: Words at least this share of which are hit make a document contaminated: 1 / SHARE.
SHARE = 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
SPANS = "array<struct<start:int,end:int>>"
SCHEMA = f"doc_id bigint, n_words bigint, n_hit bigint, n_whole bigint, items array<string>, spans {SPANS}"
HITS = "row bigint, hit binary, whole binary, items array<string>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = normal_words(text)
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                out[0].append(b" ".join(words[i : i + WINDOW]))
                out[1].append(item)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["win", "item"])


def automaton(windows: list[tuple[bytes, list[str]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for win, items in windows:
        found.add_word(f" {win.decode('latin-1')} ", (win.count(b" ") + 1, tuple(items)))
    found.make_automaton()
    return found


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges [start, end) of maximal runs of hit words in the text as it was."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


def search(found, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str]] | None:
    """Masks of the words within any window, and within a window of ``WINDOW`` words, and the items of the windows; None without a hit."""
    line = f" {b' '.join(words).decode('latin-1')} "
    hit = whole = starts = None
    items: set[str] = set()
    for end, (n, of) in found.iter(line):
        if hit is None:
            hit, whole, starts = np.zeros(len(words), bool), np.zeros(len(words), bool), np.cumsum([0, *(len(w) + 1 for w in words)])
        last = int(np.searchsorted(starts, end, "left"))  # the words before the closing space
        hit[last - n : last] = True
        if n == WINDOW:
            whole[last - n : last] = True
        items.update(of)
    return None if hit is None else (hit, whole, items)


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def _row(doc: int | None, text: str | None, words: list[bytes], got: tuple | None, spans: bool) -> tuple:
    if got is None:
        return doc, len(words), 0, 0, [], []
    hit, whole, items = got
    where = original_spans(text, hit) if spans else []
    return doc, len(words), int(hit.sum()), int(whole.sum()), sorted(items), [{"start": a, "end": b} for a, b in where]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], ["doc_id", "n_words", "n_hit", "n_whole", "items", "spans"])


def _scan(block, spans: bool):
    """(doc_id, text) -> the result's rows, from the only automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(block.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                rows.append(_row(doc, text, words, search(found, words) if words and len(found) else None, spans))
            yield _batch(rows)

    return run


def _find(block):
    """(row, text) -> the hits of one block of windows, of the rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(block.value)
        for batch in batches:
            out: list[tuple] = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                if words and (got := search(found, words)):
                    out.append((row, np.packbits(got[0]).tobytes(), np.packbits(got[1]).tobytes(), sorted(got[2])))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())), strict=True)], ["row", "hit", "whole", "items"])

    return run


def _join_blocks(spans: bool):
    """(doc_id, text, parts of the row from all blocks) -> the result's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, got = normal_words(text), None
                if parts:
                    hit, whole = (np.bitwise_or.reduce([np.frombuffer(x[k], np.uint8) for x in parts]) for k in ("hit", "whole"))
                    got = (*(np.unpackbits(x, count=len(words)).astype(bool) for x in (hit, whole)), {i for x in parts for i in x["items"]})
                rows.append(_row(doc, text, words, got, spans))
            yield _batch(rows)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_whole, items (sorted), spans (of the original text), contaminated.

    n_hit: words within any window; n_whole: those within a window of ``WINDOW`` words (not of a shorter item).
    contaminated: some word is hit, and 1 in ``SHARE`` of the words or more.  Null or wordless texts and items have no
    words and no windows; repeated items and windows count once per item id; an empty benchmark hits nothing, empty
    documents give no rows; a null item id is the string 'null'.  Null and repeated document ids are rows of their own.
    Other columns are not read.  The benchmark is the stated query set: its windows are broadcast as one automaton, or, if
    they are more than ``AUTOMATON_WINDOWS``, in blocks by hash: one block at a time passes the driver and the executors, and its
    hits are written to the checkpoint folder, then joined by a number of the row.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    wins = cut(items.mapInArrow(_windows, "win binary, item string").groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")))
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-wins.count() // AUTOMATON_WINDOWS))

    def shared(block: DataFrame):
        return spark.sparkContext.broadcast([(bytes(r.win), list(r["items"])) for r in block.toLocalIterator()])

    if blocks == 1:
        out = slim.mapInArrow(_scan(shared(wins), spans), SCHEMA)
    else:
        rows, every = cut(slim.withColumn("row", F.monotonically_increasing_id())), None
        for k in range(blocks):
            block = shared(wins.where(F.expr(f"pmod(xxhash64(win), {blocks}) = {k}")))
            hits = cut(rows.select("row", "text").mapInArrow(_find(block), HITS))
            block.unpersist()
            every = hits if every is None else every.unionByName(hits)
        # one part from each block at most
        parts = every.groupBy("row").agg(F.collect_list(F.struct("hit", "whole", "items")).alias("parts"))
        out = rows.join(parts, "row", "left").select("doc_id", "text", "parts").mapInArrow(_join_blocks(spans), SCHEMA)
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
