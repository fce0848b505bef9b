"""Embedding near-duplicates by collision counting over one-dimensional projections.

Unit vectors are projected on random Gaussian directions.  Two vectors collide on a direction if the window of half-width ``HALF`` around
one holds the other.  At cosine 0.98 the difference of two projections is normal with deviation 0.2, so that a pair
collides with probability 0.954 and in at least ``least_collisions`` of ``PROJECTIONS`` directions with a chance of 1 - 1e-6; only such
pairs are verified by cosine in double precision.

Pairs that are worth counting meet in buckets: in each of a number of tables, the vectors of a label are sorted into
the cells (``CELL`` wide, at random offsets) of several directions at once.  The number of directions grows with the logarithm of the
largest label, so that a bucket holds few vectors that are not near; the number of tables follows from it, so that a pair
at the cosine asked for misses all tables with a chance of 1e-6.  By that, rows grow as the 1.13th power of the vectors, not the
square.  Only buckets of several vectors get the vectors' counts; a pair counts in the first table where it meets, hence once.  Large
buckets are dealt into blocks, and each block pair is a group of its own.  Equal vectors of a label are one node with a
multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, cut, prepare
from .textvec import U, mix

PROJECTIONS, HALF, CELL, BLOCK = 32, 0.4, 1.2, 1024
#: Projections travel in units of 1 / SCALE; a window is a unit wider for that on each side.
SCALE = 4096
#: Chance that a pair at the cosine asked for is missed by all tables.
MISS = 1e-6
#: Vectors of one label that a bucket holds by chance, on average.
BY_CHANCE = 0.05


def least_collisions(cosine: float, miss: float = 1e-6) -> int:
    """The largest count that a pair at this cosine reaches but for a chance of miss."""
    p = math.erf(HALF / math.sqrt(2 - 2 * cosine) / math.sqrt(2)) if cosine < 1 else 1.0
    below = 0.0
    for k in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > miss:
            return k
    return PROJECTIONS


def tables_for(vectors: int, cosine: float) -> tuple[int, int]:
    """(tables, directions of a table) for so many vectors of a label."""
    alone = CELL / (2 * math.sqrt(math.pi))  # chance of two independent projections in one cell
    wide = max(1, math.ceil(math.log(max(vectors, 1) / BY_CHANCE) / -math.log(alone)))
    apart = math.sqrt(max(0.0, 2 - 2 * cosine))
    x = CELL / apart if apart else math.inf
    # E max(0, 1 - |d| / CELL) of a normal difference d
    near = math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2)) if apart else 1.0
    met = near**wide
    return (1 if met >= 1 else max(1, math.ceil(math.log(MISS) / math.log1p(-met)))), wide


class _Directions:
    """The directions of vectors of one dimension: those that are counted, those of the tables, and the tables' offsets."""

    def __init__(self, dim: int, tables: int, wide: int):
        rng = np.random.default_rng(7_000_003 + dim)
        self.counted = rng.standard_normal((dim, PROJECTIONS))
        self.cells = rng.standard_normal((dim, tables * wide))
        self.offset = rng.random(tables * wide)
        self.shape = (-1, tables, wide)


def _project(kind: str, tables: int, wide: int):
    """rep, home (a hash of the label), c, vec -> with proj (projections as int16) and keys (one for each table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Directions] = {}
        for batch in batches:
            raws = batch.column(3).to_pylist()
            home = batch.column(1).to_numpy().view(U)
            proj, keys = [b""] * len(raws), np.zeros((len(raws), tables), U)
            sizes = np.array([len(r) for r in raws])
            for size in set(sizes.tolist()):
                own = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raws[i] for i in own), kind).reshape(len(own), -1).astype(np.float64)
                dim = x.shape[1]
                d = known.setdefault(dim, None) or _Directions(dim, tables, wide)
                known[dim] = d
                x /= np.sqrt((x * x).sum(1))[:, None]
                p = np.clip(np.rint(x @ d.counted * SCALE), -32767, 32767).astype(np.int16)
                cells = np.floor(x @ d.cells / CELL + d.offset).astype(np.int64).view(U).reshape(d.shape)
                h = np.repeat(mix(home[own] + U(dim))[:, None], tables, 1) + np.arange(tables, dtype=U)
                for i in range(wide):
                    h = mix(h * U(0x9E3779B97F4A7C15) + cells[:, :, i])
                keys[own] = h
                for i, r in enumerate(own.tolist()):
                    proj[r] = p[i].tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(proj, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())], ["rep", "home", "c", "vec", "proj", "keys"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, keys -> (key, t, rep), one for each table."""
    for batch in batches:
        if len(batch):
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(batch), -1)
            t = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(t), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "t", "rep"])


def _vectors(kind: str):
    """vec as bytes of its components; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                ok = row is not None and len(row) > 0 and None not in row
                x = np.array(row, kind) + 0 if ok else None  # minus zero is zero
                out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    return run


def _links(kind: str, cosine: float, count: int):
    """Rows (key, i, j, t, rep, c, home, at, proj, keys, vec) sorted by (key, i, j): the members of one block pair after another."""
    window = round(HALF * SCALE) + 1

    def settle(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch | None:
        rep, c, home, at = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
        t = rows[0][0]
        p = np.frombuffer(b"".join(r[5] for r in rows), np.int16).reshape(len(rows), PROJECTIONS).astype(np.int32)
        a, b = (np.flatnonzero(at == i), np.flatnonzero(at == j))
        pairs = [np.zeros((0, 2), np.int64)]
        for s in range(0, len(a), 128):
            r = a[s : s + 128]
            n = np.zeros((len(r), len(b)), np.int16)
            for k in range(PROJECTIONS):
                n += np.abs(p[r, k][:, None] - p[b, k][None, :]) <= window
            near = (n >= count) & (home[r][:, None] == home[b][None, :])
            if i == j:
                near &= r[:, None] < b[None, :]
            u, v = np.nonzero(near)
            pairs.append(np.stack((r[u], b[v]), 1))
        u, v = np.concatenate(pairs).T
        if len(u) and t:  # what met in an earlier table was counted there
            keys = np.frombuffer(b"".join(r[6][: 8 * t] for r in rows), np.int64).reshape(len(rows), t)
            new = np.concatenate([~(keys[u[s : s + 65536]] == keys[v[s : s + 65536]]).any(1) for s in range(0, len(u), 65536)])
            u, v = u[new], v[new]
        if not len(u):
            return None
        x = np.frombuffer(b"".join(r[7] for r in rows), kind).reshape(len(rows), -1).astype(np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        good = np.concatenate([np.einsum("ij,ij->i", x[u[s : s + 65536]], x[v[s : s + 65536]]) >= cosine for s in range(0, len(u), 65536)])
        u, v = u[good], v[good]
        if not len(u):
            return None
        links = (np.bincount(u, c[v], len(rows)) + np.bincount(v, c[u], len(rows))).astype(np.int64)
        root = rep.copy()
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            if (new == root).all():
                break
            root = new
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(root[some])], ["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if (key, i, j) != now:
                    if len(rows) > 1 and (done := settle(now[1], now[2], rows)):
                        yield done
                    now, rows = (key, i, j), []
                rows.append(tuple(row))
        if len(rows) > 1 and (done := settle(now[1], now[2], rows)):
            yield done

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, linking vectors of equal label with cosine >= cosine.

    Null ids and labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.  Vectors of different
    length are not compared.  Equal rows count as other vectors: their links are counted, and their ids share a component.
    Other columns are not read; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    field = vectors.schema["embedding"].dataType
    kind = "f4" if isinstance(field, ArrayType) and isinstance(field.elementType, FloatType) else "f8"
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    raw = cut(every.mapInArrow(_vectors(kind), "vec_id bigint, label string, vec binary"))
    good = raw.where("vec_id is not null and label is not null and vec is not null")
    reps = cut(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c")))
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    shape = "rep bigint, home bigint, c bigint, vec binary, proj binary, keys binary"
    placed = cut(reps.select("rep", F.xxhash64("label").alias("home"), "c", "vec").mapInArrow(_project(kind, *tables_for(most, cosine)), shape))
    keys = placed.select("rep", "keys").mapInArrow(_keys, "key bigint, t int, rep bigint")
    open_ = cut(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    rows = cut(keys.join(open_, "key")).withColumn("blocks", F.expr(f"cast(ceil(members / {BLOCK}) as int)")).withColumn("at", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).join(placed, "rep")
    rows = rows.select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "t", "rep", "c", "home", "at", "proj", "keys", "vec")
    group = ["key", "i", "j"]
    found = cut(rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links(kind, cosine, least_collisions(cosine)), "rep bigint, links bigint, root bigint"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    node = reps.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(comp, F.col("rep") == comp.node, "left")
    node = cut(node.select(F.col("label").alias("of_label"), F.col("vec").alias("of_vec"), "rep", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("links"), "component"))
    out = raw.join(node, F.expr("vec_id is not null and label = of_label and vec = of_vec"), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id")).withColumn("kept", F.expr("vec_id is null or vec_id = component_id"))
