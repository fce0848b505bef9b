"""Shared plumbing: session settings, lineage cuts, tables, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Texts may be long, so that batches stay small (Spark's default of 10,000 rows of 100 kB is 1 GB).
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make sure that a checkpoint folder exists: the one that spark.checkpoint.dir names; where that is
    unset, one of this machine in local mode (as in tests), and an error on a cluster."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    while _held:
        _held.pop().unpersist()
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store that its path names, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared checkpoint folder."""
    return df.checkpoint(eager=True)


_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """The same rows, kept on the executors' disks for the uses to come; lost parts are computed again from their lineage.

    They are let go when the next operator begins (a result still in use is then computed again where needed).
    """
    _held.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Narrow rows in a task of a later round: a round over few rows needs few tasks (and few files), whatever the shuffle's setting.
ROWS_PER_TASK = 100_000


def tasks_for(rows: int) -> int:
    return rows // ROWS_PER_TASK + 1


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node with the least node that it reaches within the task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    far = [(x, r) for x in list(parent) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in far], pa.int64()), pa.array([r for _, r in far], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    edges: columns a, b (bigint).  Returns node, component (the smallest node reachable), one row per node that has an
    edge to another node.  Self-loops, repeats and null ends are ignored; no edges give no rows.  Every round is two
    partial aggregations and two joins on the node, so that no neighbourhood is ever gathered in one row; rounds end
    when the edge set stops changing (a logarithmic number of them).  Up to ROWS_PER_TASK edges need no rounds.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, seen = cut(e.distinct()), None
    # Tasks of about ROWS_PER_TASK edges first reduce their own edges to stars.
    tasks = tasks_for(e.count())
    stars = e.coalesce(tasks).mapInArrow(_forest, "u bigint, v bigint")
    e = cut(stars if tasks == 1 else stars.distinct())
    while tasks > 1:  # the stars of a single task are whole
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
        e = e.coalesce(tasks_for(mark.n))
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
    if seen:
        e = e.coalesce(tasks_for(seen[0]))
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: log2 of the bits of the map of wanted ids (8 MiB at most, whatever the input).
WANTED_BITS = 26


def _mapped(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    slot = F.expr(f"xxhash64(`{key}`) & {(1 << WANTED_BITS) - 1}L")
    maps = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("map_no")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("map_bits"))
    near = rows.withColumn("map_slot", slot).join(F.broadcast(maps), F.expr("map_slot div 32768 = map_no"), how)
    bit = "cast(conv(hex(substring(map_bits, cast((map_slot % 32768) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(map_slot % 8 as int)) <> 0"
    return near.withColumn("map_bit", F.coalesce(F.expr(bit), F.lit(False)) & F.col(key).isNotNull()).drop("map_slot", "map_no", "map_bits")


def sift(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A superset of the rows whose key is among ids (one column, named as key), made without a shuffle of the rows.

    A bit map of hashed ids, of a fixed size at any input, is broadcast; most rows of other keys are dropped by it.  Null
    keys match nothing.
    """
    return _mapped(rows, ids, key, "inner").where("map_bit").drop("map_bit")


def without_rows(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among ids: those that the bit map clears stay in place, only the others are anti-joined."""
    marked = _mapped(rows, ids, key, "left")
    rest = marked.where("map_bit").drop("map_bit").join(ids.distinct(), key, "left_anti")
    return marked.where("not map_bit").drop("map_bit").unionByName(rest)


def once_rows(rows: DataFrame, ids: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The rows, but of those whose key is among ids only one for equal values of by: that with the least other columns.

    No row of another key goes as long as its by is its own; hot keys are merged before they are shuffled.
    """
    marked = _mapped(rows, ids, key, "left")
    others = [c for c in rows.columns if c not in by]
    one = marked.where("map_bit").groupBy(*by).agg(F.min(F.struct(*others)).alias("o")).select(*by, *(F.col(f"o.{c}").alias(c) for c in others))
    return marked.where("not map_bit").drop("map_bit").unionByName(one.select(rows.columns))


def wanted_rows(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids: sifted, then semi-joined."""
    return sift(rows, ids, key).join(ids.distinct(), key, "left_semi")
