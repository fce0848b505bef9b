"""Language identification by words first, backing off to ever shorter character n-grams for unseen words.

A known word adds its log frequency in each language.  An unseen word, with borders marked, is scored by the mean log frequency of its known
n-grams of the longest length (5, 4, 3, 2, 1) of which it has any; a word without any adds nothing.  The posterior over the
languages is the softmax of the sums.

The model is learned from a bounded sample of labelled documents: those of each language with the lowest hashes, at a rate
that makes ``DOCS_PER_LANGUAGE`` of them on average.  All their words and n-grams that occur ``LEAST`` times or more in a language
are kept, as 64-bit fingerprints with one entry for each language that has them, so that the number of languages is not
bounded.  Texts are handled as arrays of code points, a slice at a time; no word is a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare
from .textvec import _BASE, U, _tables, mix, slices

DOCS_PER_LANGUAGE, LEAST, LONGEST = 2000, 2, 5
#: Levels that speak for a language and not for an alphabet only: whole words, and n-grams of three letters or more.
TELLING = (0, 3, 4, 5)
_OPEN, _CLOSE = ord("<"), ord(">")


class _Points:
    """Of each code point: its lower case, and whether it is a letter (what [^\\W\\d_] matches)."""

    low = np.zeros(0, np.uint32)
    letter = np.zeros(0, bool)

    @classmethod
    def upto(cls, top: int) -> None:
        size = 1 << 16 if top < 1 << 16 else 0x110000
        if len(cls.low) < size:
            every = [chr(i) for i in range(size)]
            cls.low = np.array([ord(y) if len(y := c.lower()) == 1 else i for i, c in enumerate(every)], np.uint32)
            cls.letter = np.array([c.isalnum() and not c.isdecimal() for c in every])


class LetterWords:
    """The words of a slice, lower-cased: code points one word after another, first (of each word), length, row_of, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        _Points.upto(int(codes.max()) if len(codes) else 0)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        codes = _Points.low[codes]
        inside = _Points.letter[codes]
        before = np.zeros(len(codes) + 1, bool)
        before[1:] = inside
        before[chars] = False
        at = np.flatnonzero(inside & ~before[:-1])
        kept = np.flatnonzero(inside)
        self.codes = codes[kept].astype(U)
        self.first = np.searchsorted(kept, at)
        self.length = np.diff(np.append(self.first, len(kept)))
        self.row_of = np.searchsorted(chars, at, "right") - 1
        if len(at):
            up, down = _tables(len(kept))
            self.hash = mix(np.add.reduceat((self.codes + U(1)) * up[: len(kept)], self.first) * down[self.first])
        else:
            self.hash = np.zeros(0, U)

    def grams(self, some: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, number of the word among some, hash) of the n-grams of these words, longest first; borders count but for n = 1."""
        length = self.length[some] + 2
        start = np.concatenate(([0], np.cumsum(length)))
        of = np.repeat(np.arange(len(some)), length)
        inside = np.arange(start[-1]) - start[of]
        codes = np.where(inside == 0, _OPEN, _CLOSE).astype(U)
        body = (inside > 0) & (inside < length[of] - 1)
        codes[body] = self.codes[(self.first[some][of] + inside - 1)[body]]
        for n in range(LONGEST, 0, -1):
            ok = body if n == 1 else inside + n <= length[of]
            at = np.flatnonzero(ok)
            total, power = np.zeros(len(at), U), 1
            for i in range(n):
                total += (codes[at + i] + U(1)) * U(power)
                power = power * _BASE % (1 << 64)
            yield n, of[at], mix(total + U(n))


def _summed(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, inverse = np.unique(keys, return_inverse=True)
    return values, np.bincount(inverse, c, len(values)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n (0: words), gram, c: counts of each slice of documents."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for at, data, offsets in slices(batch.column(1)):
            w = LetterWords(data, offsets)
            spoken = langs[at + w.row_of]
            for lang in sorted(set(langs[at : at + len(offsets) - 1])):
                own = np.flatnonzero(spoken == lang)
                hashes, some, times = np.unique(w.hash[own], return_index=True, return_counts=True)
                parts = [(0, hashes, times)] + [(n, *_summed(h, times[of])) for n, of, h in w.grams(own[some])]
                for n, h, c in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "gram", "c"])


def learn(labelled: DataFrame) -> dict:
    """A model from columns doc_id, lang, text; rows without lang or text are left out."""
    good = labelled.where("lang is not null and text is not null")
    sizes = good.groupBy("lang").agg(F.count("*").alias("docs"))
    rates = sizes.select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(float(DOCS_PER_LANGUAGE)) / F.col("docs")).alias("rate"))
    sample = good.join(F.broadcast(rates), F.col("lang") == F.col("of")).where(F.expr("(pmod(xxhash64(doc_id, 'lang'), 1048576) + 0.5d) / 1048576d < rate"))
    counts = cut(sample.select("lang", "text").mapInArrow(_count, "lang string, n int, gram bigint, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    langs = sorted(r.lang for r in sizes.select("lang").collect())
    number = {x: i for i, x in enumerate(langs)}
    totals = np.zeros((LONGEST + 1, len(langs)))
    for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect():
        totals[r.n, number[r.lang]] = r.c
    # The sample is bounded, so that what it teaches is.
    kept = counts.where(f"c >= {LEAST}").toArrow()
    of = np.array([number[x] for x in kept["lang"].to_pylist()], np.int32)
    n, gram, c = kept["n"].to_numpy(), kept["gram"].to_numpy().view(U), kept["c"].to_numpy()
    tables, floors = [], np.zeros((LONGEST + 1, len(langs)))
    for level in range(LONGEST + 1):
        own = np.flatnonzero(n == level)
        own = own[np.lexsort((of[own], gram[own]))]
        values, first = np.unique(gram[own], return_index=True)
        tables.append((values, np.append(first, len(own)), of[own], np.log(2.0 * c[own] + 1)))
        floors[level] = np.log(0.5 / (totals[level] + 0.5 * max(1, len(values))))
    return {"langs": langs, "tables": tables, "floors": floors}


def _found(values: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among sorted values, or -1."""
    if not len(values):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    return np.where(values[at] == hashes, at, -1)


def _entries(table: tuple, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in at, language, weighted log count over the floor) of each entry of the places at."""
    _, first, lang, gain = table
    n = first[at + 1] - first[at]
    of = np.repeat(np.arange(len(at)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
    return of, lang[i], gain[i] * weight[of]


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.tables, self.floors = model["langs"], model["tables"], model["floors"]

    def levels(self, w: LetterWords, words: np.ndarray) -> tuple[np.ndarray, list]:
        """Level of each word (0 known, n of its n-grams, -1 none), and entries (word, language, value)."""
        level = np.full(len(words), -1)
        at = _found(self.tables[0][0], w.hash[words])
        known = np.flatnonzero(at >= 0)
        level[known] = 0
        of, lang, value = _entries(self.tables[0], at[known], np.ones(len(known)))
        parts = [(known[of], lang, value)]
        unseen = np.flatnonzero(at < 0)
        for n, of, h in w.grams(words[unseen]) if len(unseen) else ():
            open_ = level[unseen[of]] < 0
            of, h = of[open_], h[open_]
            at = _found(self.tables[n][0], h)
            of, at = of[at >= 0], at[at >= 0]
            many = np.bincount(of, minlength=len(unseen))
            level[unseen[many > 0]] = n
            i, lang, value = _entries(self.tables[n], at, 1 / many[of])
            parts.append((unseen[of[i]], lang, value))
        return level, parts

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: no letter, or nothing learned), its posterior, and the share of telling words, of each row."""
        rows, some, spoken = len(offsets) - 1, len(self.langs), LetterWords(data, offsets)
        has = np.bincount(spoken.row_of, minlength=rows)
        if not some or not len(spoken.hash):
            return np.full(rows, -1), np.zeros(rows), np.zeros(rows)
        _, words, inverse = np.unique(spoken.hash, return_index=True, return_inverse=True)
        level, parts = self.levels(spoken, words)
        seen = np.bincount(spoken.row_of * (LONGEST + 2) + level[inverse] + 1, minlength=rows * (LONGEST + 2)).reshape(rows, -1)[:, 1:]
        total = seen @ self.floors
        # (row, word) pairs with how often, each times the entries of its word
        pair, times = np.unique(spoken.row_of * len(words) + inverse, return_counts=True)
        row, word = pair // len(words), pair % len(words)
        of, lang, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(of, kind="stable")
        of, lang, value = of[order], lang[order], value[order]
        first = np.searchsorted(of, np.arange(len(words) + 1))
        table = (None, first, lang, value)
        i, lang, gain = _entries(table, word, times.astype(float))
        total += np.bincount(row[i] * some + lang, gain, rows * some).reshape(rows, some)
        best = total.argmax(1)
        post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        none = has == 0
        return np.where(none, -1, best), np.where(none, 0.0, post), seen[:, TELLING].sum(1) / np.maximum(has, 1)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        names = np.array([*score.langs, "und"], object)
        for batch in batches:
            *rest, text = batch.columns
            done = [score(data, offsets) for _, data, offsets in slices(text)]
            best, post, told = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int), np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best], pa.string()), pa.array(post), pa.array(told)], [*batch.schema.names[:-1], "lang_pred", "score", "told"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def annotate(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of docs (other than these names) with lang_pred, score and told (share of words that are known or have known n-grams of three letters or more) of the text."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "told")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("text_to_predict"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema + "lang_pred string, score double, told double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, told of every document row.

    Learns from text and lang of the rows whose crc32(doc_id as text) mod 3 is not 1; predicts from text alone.  und with score 0: null
    texts, texts without a letter, and any text if nothing could be learned; letters that no language knows give equal
    scores, of which the first language by code point is taken, and told 0.  Null ids are not held out; repeated rows get equal
    results; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    out = annotate(slim.select("doc_id", "text"), learn(slim.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "told")
