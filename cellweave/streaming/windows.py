"""Stateful one-pass operators as Structured Streaming; the same functions run on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if late else x


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, n, total of fixed windows; later than the watermark is dropped by the stream."""
    g = _timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    g = _timed(events, late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """user_id, start, end, n: a session ends a gap after its last event."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(keys)


def position_counts(bases: DataFrame) -> DataFrame:
    """Running pileup counts by tid, pos, base: with outputMode update, a position is emitted again whenever reads add to it."""
    return bases.groupBy("tid", "pos", "base").agg(F.count("*").alias("n"), F.max("qual").alias("qual"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    return q


#: Milliseconds of event time between contigs in a sweep: more than any position.
CONTIG_STRIDE = 1 << 33
#: A contig number behind all others: a row of it ends a sweep.
LAST_CONTIG = 1 << 20


def sweep(bases: DataFrame, slack: int = 1000) -> DataFrame:
    """tid, pos, base, n, qual of a stream of bases in order of tid and pos, give or take slack positions; for output mode append.

    The place on the genome is the event time, so that the watermark is the sweep line: a position is emitted once, when no read before it can
    come any more, and its state goes.  Rows behind the line are late: they are dropped and counted (``late_rows``).  The
    line moves after a batch, so two rows of contigs LAST_CONTIG and LAST_CONTIG + 1, a batch each, end the sweep; they
    are not emitted.
    """
    at = F.timestamp_millis(F.col("tid").cast("bigint") * CONTIG_STRIDE + F.col("pos") + 1)
    g = bases.withColumn("at", at).withWatermark("at", f"{slack} milliseconds").groupBy("at", "tid", "pos", "base").agg(F.count("*").alias("n"), F.max("qual").alias("qual"), F.max("tid").alias("contig"))
    # By an aggregate, which can't move below the watermark: the rows that end the sweep must reach it.
    return g.where(F.col("contig") < LAST_CONTIG).drop("at", "contig")


def to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there by now in micro-batches, appended to Parquet files; a restart goes on from the checkpoint folder."""
    q = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).start(path)
    q.processAllAvailable()
    q.stop()
    return q


def late_rows(query: StreamingQuery, strict: bool = False) -> int:
    """Rows that came behind the watermark, over all batches; strict: an error if there are any."""
    n = sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
    if strict and n:
        raise ValueError(f"{n} rows are out of order")
    return n


def progress(query: StreamingQuery) -> list[tuple[int, int, float, int]]:
    """(batch, input rows, rows a second, rows of state) of the batches so far."""
    return [(p["batchId"], p["numInputRows"], p["processedRowsPerSecond"] or 0.0, sum(op["numRowsTotal"] for op in p["stateOperators"])) for p in query.recentProgress]
