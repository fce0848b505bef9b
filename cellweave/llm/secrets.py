"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the characters of tokens, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a token of ``SHORTEST`` characters or more is a secret if the ratio is high in total and by character.
Without samples of one's own, ``labelled_samples`` makes them: strings drawn from the alphabets that keys are written in are
random, identifiers put together from common words and numbers are ordinary.  What the corpus calls ordinary is learned as well: the
transitions of all tokens of all documents but those that the fixed patterns find count for the ordinary model.  The
model is two tables of fixed size.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textvec import slices

ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
SHORTEST, LEAST_TOTAL, LEAST_MEAN = 16, 15.0, 0.75
_ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(_ALPHABET) + 1  # 0: outside of tokens
_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate(_ALPHABET):
    _CODE[_c] = _i + 1
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def runs(mask: np.ndarray, least: int) -> np.ndarray:
    """[start, end) of maximal runs of at least so many trues."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    pairs = edge.reshape(-1, 2)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


def base_spans(raw: bytes, data: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, in order."""
    found = []
    if b"=" in raw or b":" in raw:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    data = np.frombuffer(raw, np.uint8) if data is None else data
    found += [(int(a), int(b), 2) for a, b in runs(_HEX[data], 24)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def runs_within(mask: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """[start, end) of maximal runs of at least so many trues that end at the borders of rows."""
    n = len(mask)
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    first, last = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    start[first] |= mask[first]
    end[last] |= mask[last]
    pairs = np.stack((np.flatnonzero(start), np.flatnonzero(end) + 1), 1)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


def transitions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of pairs of symbols, with an outside symbol before and after each row."""
    code = np.insert(_CODE[data], offsets, 0).astype(np.int32)
    return np.bincount(code[:-1] * SYMBOLS + code[1:], minlength=SYMBOLS * SYMBOLS)


def _of_token(raw: bytes) -> np.ndarray:
    return transitions(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


#: Random and ordinary strings of the labelled sample, of each kind.
SAMPLES = 4000
#: Words that identifiers are often made of.
COMMON = """account action address array async attribute base batch block body buffer button cache call cell channel char check
child class client close code collection color column command config connection container content context control copy count
create current customer data database date default delete description device document domain element email enable engine entry
error event example exception export factory field file filter find first flag folder format frame function group handler hash
header height image import index info input instance item iterator job key label language last layer length level library
limit line link list load local location login manager map mapping match max message method model module name network next node
number object offset option order output owner package page param parent parse password path pattern payment period person phone
point policy port position prefix price print process product profile program project property provider query queue random range
read record reference region register release remove render report request reset resource response result return role root route
row rule sample save scale schema scope score screen script search section select sequence server service session set size
sort source space start state status step storage store stream string style summary system table target task template test text
thread time title token total transaction transform type unit update upload user validate value vector version view visible
width window word write""".split()


def labelled_samples(seed: int = 11) -> list[tuple[str, bool]]:
    """(text, label): strings drawn letter by letter from the alphabets of keys, and identifiers in the usual spellings, numbers and paths."""
    rng = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [digits + "abcdef", digits + "ABCDEF", lower + digits, lower.upper() + digits, lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "-_"]
    out = [("".join(rng.choices(letters, k=rng.randint(SHORTEST, 64))), True) for letters in alphabets for _ in range(SAMPLES)]
    spell = [
        "_".join, "-".join, "/".join, "".join, lambda w: "_".join(w).upper(), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(x.title() for x in w), lambda w: w[0].upper() + "".join(x.title() for x in w[1:]),
        lambda w: "_".join(w) + str(rng.randint(0, 9999)), lambda w: "-".join(w) + f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
    ]
    out += [(f(rng.choices(COMMON, k=rng.randint(1, 5))), False) for f in spell for _ in range(SAMPLES)]
    return out + [("".join(rng.choices(digits, k=rng.randint(4, 24))), False) for _ in range(SAMPLES)]


def _rows(counts: dict[bool, np.ndarray]) -> pa.RecordBatch:
    out: list[np.ndarray] = [[], [], []]
    for label, c in counts.items():
        at = np.flatnonzero(c > 0)
        out = [np.append(out[0], np.full(len(at), label)), np.append(out[1], at), np.append(out[2], c[at])]
    return pa.RecordBatch.from_arrays([pa.array(out[0].astype(bool)), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int64))], ["random", "pair", "c"])


def _from_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transitions of all tokens but those that the patterns find."""
    counts = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            counts += transitions(data, offsets)
            for r in _rows_to_scan(data, offsets).tolist():
                a, b = int(offsets[r]), int(offsets[r + 1])
                raw = data[a:b].tobytes()
                for start, end, kind in base_spans(raw, data[a:b]):
                    counts -= _of_token(ASSIGN.match(raw, start)[1] if kind == 0 else raw[start:end])
    yield _rows({False: counts})


def _from_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {label: np.zeros(SYMBOLS * SYMBOLS, np.int64) for label in (False, True)}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[bool(label)] += _of_token((text or "").encode())
    yield _rows(counts)


def _rows_to_scan(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a slice in which some pattern could match: = or :, AKIA, or a run of 24 hexadecimal digits within the row."""
    spots = [np.flatnonzero((data == 61) | (data == 58)), runs_within(_HEX[data], offsets, 24)[:, 0]]
    if len(data) > 3:
        spots.append(np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65)))
    return np.unique(np.searchsorted(offsets, np.concatenate(spots), "right") - 1)


def ratio_table(counts: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition from summed counts (random, pair, c).

    Both models back off to how frequent the next character is at all, so that what ordinary tokens never hold is unlikely
    after anything; a tenth of the random model is uniform, as random strings may hold any pair."""
    c = np.zeros((2, SYMBOLS, SYMBOLS))
    for r in counts.groupBy("random", "pair").agg(F.sum("c").alias("c")).collect():  # at most 2 * SYMBOLS ** 2 rows
        c[int(r.random), r.pair // SYMBOLS, r.pair % SYMBOLS] += max(r.c, 0)
    alone = c.sum(1) + 0.5
    alone /= alone.sum(1, keepdims=True)
    p = (c + 5 * alone[:, None, :]) / (c.sum(2, keepdims=True) + 5)
    return np.log(0.9 * p[1] + 0.1 / SYMBOLS) - np.log(p[0])


def _label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.select(F.col("text").cast("string"), F.col("label").cast("boolean")).mapInArrow(_from_labels, "random boolean, pair int, c bigint")


def train(labelled: DataFrame, texts: DataFrame | None = None) -> np.ndarray:
    """The model from a labelled sample: columns text and label (true: a random string); null texts and labels count as '' and false.

    texts (column text): all their tokens but those that the patterns find are ordinary too.
    """
    counts = _label_counts(labelled)
    if texts is not None:
        counts = counts.unionByName(texts.select(F.col("text").cast("string")).mapInArrow(_from_corpus, "random boolean, pair int, c bigint"))
    return ratio_table(counts)


def markov_spans(data: np.ndarray, table: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[start, end) of tokens, within rows, whose ratio is high enough."""
    code = _CODE[data].astype(np.int32)
    spans = runs_within(code > 0, offsets, SHORTEST)
    if not len(spans):
        return spans
    a, b = spans[:, 0], spans[:, 1]
    step = np.concatenate(([0.0], np.cumsum(table[code[:-1], code[1:]])))
    score = step[b - 1] - step[a] + table[0, code[a]] + table[code[b - 1], 0]
    return spans[(score >= LEAST_TOTAL) & (score >= LEAST_MEAN * (b - a))]


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether spans, in order of their starts, hold all of a range."""
    for a, b, _ in spans:
        if a <= start < b:
            start = b
    return start >= end


def _scan(model, redact: bool):
    empty = hashlib.sha256(b"").hexdigest()
    names = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            n = len(batch)
            counts, digest, spans, texts = np.zeros((n, 4), np.int64), [empty] * n, [""] * n, {}
            column = batch.column(batch.num_columns - 1)
            for first, data, offsets in slices(column):
                extra = markov_spans(data, table, offsets)
                bound = np.searchsorted(extra[:, 0], offsets)
                for r in np.union1d(_rows_to_scan(data, offsets), np.flatnonzero(np.diff(bound))).tolist():
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    raw = data[a:b].tobytes()
                    base = base_spans(raw, data[a:b])
                    own = extra[bound[r] : bound[r + 1]] - a
                    more = [(s, e, 3) for s, e in own.tolist() if not _covered(s, e, base)]
                    if not base and not more:
                        continue
                    chars = np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))
                    line = lambda found: ",".join(f"{KINDS[k]}:{chars[s]}:{chars[e]}" for s, e, k in sorted(found, key=lambda x: (x[0], x[2])))  # noqa: E731, B023
                    digest[first + r] = hashlib.sha256(line(base).encode()).hexdigest()
                    spans[first + r] = line(base + more)
                    for _, _, k in base + more:
                        counts[first + r, k] += 1
                    if redact:
                        out, last = [], 0
                        for s, e, k in sorted(base + more):
                            if e > last:
                                out += [raw[last:s] if s > last else b"", b"[SECRET]"] if s >= last else []
                                last = max(last, e)
                        texts[first + r] = b"".join([*out, raw[last:]]).decode()
            kept = pa.array([texts.get(i) for i in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *(pa.array(counts[:, k]) for k in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string()), kept], [*batch.schema.names, *names])

    return run


def find_secrets(docs: DataFrame, model: np.ndarray | None = None, redact: bool = False, text_col: str = "text") -> DataFrame:
    """All columns of the documents (other than these names) with n_assign, n_access, n_hex, n_markov, base_sha256, spans, redacted.

    spans: kind:start:end in code points, end exclusive, by start, then kind (assign, access, hex, markov), joined by commas.
    A markov span may reach beyond spans of patterns but is never within them.  redacted (with redact): the text with each run of
    overlapping secrets replaced by [SECRET], null where there is none.  model: from ``train``; None trains on
    ``labelled_samples`` and the texts themselves.  Null texts are empty; repeated rows get equal results, whatever rows are beside
    them; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    if model is None:
        model = train(spark.createDataFrame(labelled_samples(), "text string, label boolean"), text)
    added = "n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string, redacted string"
    others = [c for c in docs.columns if c not in {x.split()[0] for x in added.split(", ")}]
    rows = docs.select(*(F.col(f"`{c}`") for c in others), F.col(text_col).cast("string").alias("scanned_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + added
    return rows.mapInArrow(_scan(spark.sparkContext.broadcast(model), redact), schema).drop("scanned_text")
