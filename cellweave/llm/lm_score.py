"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

All words are leaves of a tree of classes: 16 classes of 16 classes of 16 leaves.  The 2047 most frequent training tokens have a
leaf each, in order of frequency; every other word, unseen ones too, shares one of 2048 leaves with those of its hash.

    log P(word | history) = log P(class | history) + log P(class 2 | class, history) + log P(leaf | classes, history) + log P(word | leaf)

The first three factors are softmaxes whose weights are rows of hashed tables, one row for each active feature: the word
before, the two words before, and the word two back alone (a skip).  Within a shared leaf, a word has its add-one
share of the leaf's training counts, so that every text has a probability.

Training is one pass over all training tokens of local gradient updates in sparse numpy batches, a copy of the weights in each
task; the copies are averaged row by row, weighted by how often each task used the row.  Tables grow with the square
root of the training tokens, and so does the number of copies, so that what is averaged grows like the input.  Scoring is
another pass.  Word counts are sums over the whole corpus; counts of the ``KNOWN`` most frequent words are broadcast (a
fixed size), those of other words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, prepare
from .textvec import U, Words, mix, slices

#: Children of a node, levels of the tree, words with a leaf of their own, leaves that other words share (a power of two).
WIDE, LEVELS, SINGLE, SHARED = 16, 3, 2047, 2048
LEAVES = WIDE**LEVELS
KNOWN = 1 << 18
#: log2 of the rows of each table, at least and at most (each row holds WIDE weights of 4 bytes).
LEAST_BITS, MOST_BITS = 14, 20
FEATURES, BATCH, RATE = 3, 16384, 0.6
END = 0x51_7C_C1_B7_27_22_0A_95
_BEGIN = 0x2F_72_B4_21_5A_3D_8C_AF
#: Table rows in one packed row while copies are averaged.
_PIECE = 2048


def table_bits(tokens: int) -> int:
    """log2 of the rows of a table: half of that of the tokens, and three."""
    return int(np.clip(round(np.log2(max(tokens, 1)) / 2) + 3, LEAST_BITS, MOST_BITS))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Tokens:
    """Token fingerprints of a slice, an end after each row's words, with features and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, lower=True)
        rows = len(offsets) - 1
        self.row = np.concatenate((w.row_of, np.arange(rows)))
        order = np.argsort(self.row, kind="stable")  # the end comes after the words
        self.row = self.row[order]
        self.hash = np.concatenate((w.hash, np.full(rows, END, U)))[order]

    def features(self) -> list[np.ndarray]:
        """32 bits of each feature of each token."""
        n = len(self.hash)
        back = []
        for k in (1, 2):
            x = np.full(n, _BEGIN, U)
            if n > k:
                x[k:] = np.where(self.row[k:] == self.row[:-k], self.hash[:-k], U(_BEGIN))
            back.append(x)
        one, two = back
        return [(mix(x) >> U(32)).astype(np.uint32) for x in (one + U(1), one * U(0x9E3779B97F4A7C15) + two, two + U(2))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            held.append(Tokens(data, offsets).hash)
            if sum(map(len, held)) >= 2_000_000:
                yield out()
                held.clear()
    if held:
        yield out()


def _shared_leaf(hashes: np.ndarray) -> np.ndarray:
    """The leaf of words without a leaf of their own."""
    return (LEAVES - SHARED + (hashes >> U(40) & U(SHARED - 1)).astype(np.int64)).astype(np.int32)


class Model:
    """What every task needs: the known words by fingerprint (count, leaf), masses of leaves, and weights."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, total: int, distinct: int, shared: np.ndarray):
        """shared: of each shared leaf, the sum of count + 1 over all training words of its hash."""
        order = np.argsort(known)
        self.known, self.count = known[order], counts[order]
        self.leaf = _shared_leaf(self.known)
        best = np.lexsort((self.known, -self.count))[:SINGLE]
        mass = np.zeros(LEAVES)
        mass[LEAVES - SHARED :] = shared + 1  # one for unseen words
        np.subtract.at(mass, self.leaf[best], self.count[best] + 1.0)
        self.leaf[best] = np.arange(len(best))
        mass[: len(best)] = self.count[best] + 1
        self.total, self.distinct = total, distinct
        self.log_mass = np.where(np.arange(LEAVES) < LEAVES - SHARED, 0.0, np.log10(np.maximum(mass, 1)))
        self.biases = []
        for level in range(LEVELS):  # log share of each child of each node
            inside = mass.reshape(WIDE**level, WIDE, -1).sum(2)
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.log(inside / inside.sum(1, keepdims=True))
            self.biases.append(np.where(inside > 0, share, -1e9).astype(np.float32))
        self.bits = table_bits(total)
        self.tables: list[np.ndarray] | None = None

    @classmethod
    def of(cls, parts: dict) -> Model:
        """The model of its attributes, as they are broadcast (without this class, which executors needn't be able to import)."""
        model = cls.__new__(cls)
        model.__dict__.update(parts)
        return model

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, or -1 if it isn't known here; leaf) of each token, through the distinct ones."""
        values, inverse = np.unique(hashes, return_inverse=True)
        leaf = _shared_leaf(values)
        if not len(self.known):
            return np.full(len(hashes), -1), leaf[inverse]
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        same = self.known[at] == values
        return np.where(same, self.count[at], -1)[inverse], np.where(same, self.leaf[at], leaf)[inverse]

    def blank(self) -> list[np.ndarray]:
        return [np.zeros((1 << self.bits, WIDE), np.float32) for _ in range(LEVELS)]


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x


def _forward(model: Model, tables: list[np.ndarray], features: list[np.ndarray], leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(probabilities of the children, the child taken, table rows) of each level, for a batch."""
    mask = np.uint32((1 << model.bits) - 1)
    for level in range(LEVELS):
        node, child = leaf // WIDE ** (LEVELS - level), leaf // WIDE ** (LEVELS - 1 - level) % WIDE
        x = model.biases[level].take(node, 0)
        salt = (node + 1).astype(np.uint32) * np.uint32(0x9E3779B1)
        rows = [(_mix32(f ^ salt) if level else f) & mask for f in features]
        for r in rows:
            x += tables[level].take(r, 0)
        np.exp(np.minimum(x, 60, out=x), out=x)
        x /= x.sum(1, keepdims=True)
        yield x, child, rows


def _sorted(x: np.ndarray) -> np.ndarray:
    """The order of 32-bit values, by radix."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    high = (x >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _descend(table: np.ndarray, used: np.ndarray, p: np.ndarray, target: np.ndarray, rows: list[np.ndarray]) -> None:
    """One gradient step: each row moves by its summed gradient over the square root of its uses so far."""
    p[np.arange(len(target)), target] -= 1
    for r in rows:
        order = _sorted(r)
        values = r.take(order)
        last = np.flatnonzero(np.append(values[1:] != values[:-1], True))
        at = values.take(last)
        step = np.cumsum(p.take(order, 0), axis=0).take(last, 0)
        step[1:] -= step[:-1].copy()
        uses = used.take(at) + np.diff(last, prepend=-1).astype(np.float32)
        used[at] = uses
        table[at] -= step * ((RATE / FEATURES) / np.sqrt(uses))[:, None]


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        tables, used = model.blank(), [np.zeros(1 << model.bits, np.float32) for _ in range(LEVELS)]
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                tokens = Tokens(data, offsets)
                _, leaf = model.look_up(tokens.hash)
                features = tokens.features()
                for i in range(0, len(leaf), BATCH):
                    for level, (p, child, rows) in enumerate(_forward(model, tables, [f[i : i + BATCH] for f in features], leaf[i : i + BATCH])):
                        _descend(tables[level], used[level], p, child, rows)
        for t in range(LEVELS):
            for i in range(0, len(tables[t]), _PIECE):
                n = used[t][i : i + _PIECE]
                if n.any():
                    part = np.hstack((tables[t][i : i + _PIECE] * n[:, None], n[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([i], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["t", "at", "part"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for t, at, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(part, np.float32)
            sums[t, at] = sums[t, at] + x if (t, at) in sums else x.copy()
    for (t, at), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["t", "at", "part"])


def _score(shared):
    names = ["uid", "doc_id", "h", "rare", "k", "n_tokens", "n_known", "base", "model"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def batch_of(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        for batch in batches:
            uids, ids = batch.column(0).to_numpy(), batch.column(1)
            for first, data, offsets in slices(batch.column(2)):
                rows = len(offsets) - 1
                tokens = Tokens(data, offsets)
                count, leaf = model.look_up(tokens.hash)
                features = tokens.features()
                log = np.zeros(len(leaf))
                for i in range(0, len(leaf), BATCH):
                    for p, child, _ in _forward(model, model.tables, [f[i : i + BATCH] for f in features], leaf[i : i + BATCH]):
                        log[i : i + BATCH] += np.log10(np.maximum(p[np.arange(len(child)), child], 1e-30))
                known = count >= 0
                own = np.where(known, np.log10(np.maximum(count, 0) + 1.0), 0.0)  # of other words once they are joined
                base = own - np.log10(model.total + model.distinct + 1.0)
                log += np.where(leaf < LEAVES - SHARED, 0.0, own - model.log_mass[leaf])
                sums = [np.bincount(tokens.row, x, rows) for x in (np.ones(len(leaf)), known, base, log)]
                uid, doc = uids[first : first + rows], ids.slice(first, rows)
                zero = np.zeros(rows, np.int64)
                yield batch_of([uid, doc, mix(uid.view(U)).view(np.int64), zero.astype(bool), zero, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3]])
                rare = np.flatnonzero(~known)
                if len(rare):
                    pair = np.stack((tokens.row[rare].astype(U), tokens.hash[rare]), 1)
                    order = np.lexsort((pair[:, 1], pair[:, 0]))
                    pair = pair[order]
                    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]).any(1))))
                    k = np.diff(np.append(new, len(pair)))
                    row = pair[new, 0].astype(np.int64)
                    zero = np.zeros(len(row), np.int64)
                    yield batch_of([uid[row], doc.take(pa.array(row)), pair[new, 1].view(np.int64), np.ones(len(row), bool), k, zero, zero, zero.astype(float), zero.astype(float)])

    return run


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts (column text), and their token counts (h, c)."""
    spark = texts.sparkSession
    counts = hold(texts.mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Known words: all counts from a level on, with at most KNOWN words; levels are 64 to a doubling.
    level = F.floor(F.log2("c") * 64)
    least, words = 1 << 30, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if words + r["count"] > KNOWN:
            break
        least, words = r.level, words + r["count"]
    top = counts.where(level >= least).toPandas()
    shared = np.zeros(SHARED)
    for r in counts.groupBy(F.expr(f"shiftrightunsigned(h, 40) & {SHARED - 1}").alias("leaf")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        shared[r.leaf] = r.m
    model = Model(top["h"].to_numpy(np.int64).view(U), top["c"].to_numpy(np.int64), int(size.n), int(size.v), shared)
    tasks = texts.rdd.getNumPartitions()
    copies = texts.coalesce(max(1, min(tasks, int(np.ceil(4 * np.sqrt(tasks))))))
    parts = copies.mapInArrow(_train(spark.sparkContext.broadcast(vars(model))), "t int, at int, part binary")
    # Copies are summed in two steps, so that no task gets a piece from every other.
    some = parts.withColumn("lot", F.spark_partition_id() % 16).repartition("t", "at", "lot").select("t", "at", "part").mapInArrow(_add, "t int, at int, part binary")
    tables = model.blank()
    for r in some.repartition("t", "at").mapInArrow(_add, "t int, at int, part binary").toLocalIterator():
        x = np.frombuffer(r.part, np.float32).reshape(min(_PIECE, len(tables[r.t])), -1)
        tables[r.t][r["at"] : r["at"] + len(x)] = x[:, :-1] / np.maximum(x[:, -1:], 1)
    model.tables = tables
    return model, counts


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2 (null ids are learned from).  A null or blank text is
    its end token alone.  Repeated rows are scored each; other columns are not read; an empty table gives no rows.  With no
    training rows, every token is unknown, and the base score of each is 0 (log10 of 1 / 1).
    """
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model, counts = fit(slim.where(~held_out()).select("text"))
    rows = slim.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    schema = "uid bigint, doc_id bigint, h bigint, rare boolean, k bigint, n_tokens bigint, n_known bigint, base double, model double"
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(vars(model))), schema)
    seen = scored.join(counts.select(F.col("h").alias("word"), "c"), F.expr("rare and h = word"), "left")
    log = F.expr("if(rare, k * log10(coalesce(c, 0) + 1), 0d)")
    out = seen.groupBy("uid", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.expr("n_known + if(rare and c is not null, k, 0)")).alias("n_known"),
        F.sum(F.col("base") + log).alias("base_score"),
        F.sum(F.col("model") + log).alias("score"),
    )
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")
