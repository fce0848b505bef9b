"""Mixing sources to target weights by entropy balancing.

Rates of documents are as close to 1 as the token constraints allow, in relative entropy and with rates up to 2: the convex
dual has one multiplier for each source, and the rate of a document is min(2, exp(multiplier * size / mean size)).  Newton
steps on the dual (kept within a bracket) run as aggregations over the counts of sizes by source.  Rates become copies:
the whole part at once, the rest by priority sampling - documents in order of a hash over their fraction, up to the words
that the source still lacks, found in a histogram of that order and then within its one critical bin.  At last one document
of each source, the one whose size is nearest to what is left over or lacking, gains or loses a copy if that helps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: No document is taken more often than this, so no target exceeds this times its source's size.
MOST = 2
#: Bins of the order in which the fractions are rounded.
BINS = 65536
#: Sources up to which their table is broadcast (its rows are counted first; more are joined by a shuffle).
BROADCAST_SOURCES = 10_000


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """key, n, source_size, target of every source: share of all words by weight, none above MOST times its size."""
    src = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.expr("if(size > 0, 1, 0)")).alias("n"), F.min(F.expr("if(size > 0, size, null)")).alias("least"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("weight", weight).withColumn("ratio", F.expr(f"{MOST} * source_size / weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * share
    lower = F.coalesce(F.sum(F.expr(f"{MOST} * source_size")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (total - lower) / rest)
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    return src.withColumn("target", F.least(F.expr(f"double({MOST} * source_size)"), F.coalesce(free, F.lit(float("inf"))) * F.col("weight"))).drop("ratio", "level")


def _solve(hist: DataFrame, src: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    """key, lam: the multiplier of each source with 0 < target < MOST * size; null where the answer is none or all."""
    open_ = src.where(f"target > 0 and target < {MOST} * source_size * (1 - 1e-12)")
    rho = F.expr("target / source_size")
    x = F.expr("least * n / source_size")
    state = open_.select(
        "key", "target", (F.col("source_size") / F.col("n")).alias("mean"),
        F.when(rho >= 1, 0.0).otherwise(F.log(rho) / x).alias("lo"), F.when(rho >= 1, F.log(F.lit(float(MOST))) / x).otherwise(0.0).alias("hi"),
        F.when(rho >= 1, F.log(rho)).otherwise(F.log(rho)).alias("lam"), F.lit(1.0).alias("off"),
    )
    state = cut(state.withColumn("lam", F.expr("least(greatest(lam, lo), hi)")))
    for _ in range(rounds):
        rate = F.expr(f"least({MOST}d, exp(lam * size / mean))")
        parts = hist.join(state, "key").withColumn("rate", rate)
        sums = parts.groupBy("key").agg(F.sum(F.expr("n * size * rate")).alias("f"), F.sum(F.expr(f"if(rate < {MOST}, n * size * rate * size / mean, 0d)")).alias("d"))
        new = state.join(sums, "key").withColumn("g", F.expr("f - target")).withColumn("lo", F.expr("if(g <= 0, lam, lo)")).withColumn("hi", F.expr("if(g >= 0, lam, hi)"))
        new = new.withColumn("step", F.expr("if(d > 0, lam - g / d, null)")).withColumn("lam", F.expr("if(step > lo and step < hi, step, if(g = 0, lam, (lo + hi) / 2))"))
        state = cut(new.select("key", "target", "mean", "lo", "hi", "lam", F.expr("abs(g) / target").alias("off")))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    # The last digits depend on the order of sums; without them, reruns agree.
    return state.select("key", F.round("lam", 10).alias("lam"), "mean")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken of every document row, after the columns named by carry.

    Size: words (runs of anything but ASCII white space) of the text, 0 for null.  Sources by code point, null last (a
    source of its own), take the weights in turn.  A source's copies miss its target by half a document at most.  Sources
    without words have target 0; documents without words have rate and copies as the others' formula says and take 0.  Equal
    rows are separate documents with the same rate; ties are broken by id and size, so that reruns agree.  Other columns
    than those of carry (none named as one of this operator's) are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    sized = cut(docs.select(*carry, F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")).withColumn("key", key))
    src = cut(source_targets(sized, weights, share))
    hist = cut(sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    src = cut(src.join(_solve(hist, src, 1e-9, 60), "key", "left"))
    few = src.count() <= BROADCAST_SOURCES

    def by_source(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(side) if few else side, "key", how)

    rate = F.expr(f"case when target <= 0 then 0d when lam is null then {MOST}d else least({MOST}d, exp(lam * size / mean)) end")
    rated = by_source(sized, src.select("key", "source_size", "target", "lam", "mean")).withColumn("rate", rate)
    rated = rated.withColumn("whole", F.expr("if(rate >= 2 - 1e-12, 2, floor(rate))")).withColumn("part", F.expr("greatest(rate - whole, 0d)"))
    dice = F.expr("(pmod(xxhash64(doc_id, 'mix'), 4503599627370496) + 0.5d) / 4503599627370496d")
    rated = rated.withColumn("turn", F.when((F.col("part") > 0) & (F.col("size") > 0), dice / (dice + F.col("part"))))
    rated = cut(rated.withColumn("bin", F.floor(F.col("turn") * BINS)).withColumn("row", F.monotonically_increasing_id()).select(*carry, "row", "doc_id", "key", "size", "source_size", "target", "rate", "whole", "turn", "bin"))
    lack = rated.groupBy("key").agg((F.first("target") - F.sum(F.expr("whole * size"))).alias("lack"))
    bins = rated.where("turn is not null").groupBy("key", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("bin")
    bins = bins.withColumn("before", F.sum("words").over(upto) - F.col("words")).join(lack, "key")
    edge = cut(bins.where("before < lack").groupBy("key").agg(F.max(F.struct("bin", "before", "lack")).alias("e")).select("key", F.col("e.bin").alias("edge"), "e.before", "e.lack"))
    marked = by_source(rated, edge, "left")
    sure = marked.where("turn is null or edge is null or bin <> edge").withColumn("extra", F.expr("if(bin < edge, 1, 0)"))
    inner = Window.partitionBy("key").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = marked.where("bin = edge").withColumn("sofar", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    near = near.withColumn("extra", F.expr("if(sofar + size / 2 <= lack, 1, 0)")).drop("sofar")
    out = cut(sure.unionByName(near).withColumn("copies", F.expr("cast(whole + coalesce(extra, 0) as int)")).select(*carry, "row", "doc_id", "key", "size", "source_size", "target", "rate", "copies"))
    gap = out.groupBy("key").agg((F.first("target") - F.sum(F.expr("copies * size"))).alias("gap"))
    able = by_source(out, gap).where(f"size > 0 and if(gap > 0, copies < {MOST}, copies > 0)")
    best = able.groupBy("key").agg(F.min(F.struct(F.expr("abs(size - abs(gap))").alias("left"), "doc_id", "row", "gap")).alias("b"))
    best = best.where("b.left < abs(b.gap)").select("key", F.col("b.row").alias("fixed"), F.expr("cast(sign(b.gap) as int)").alias("more"))
    out = by_source(out, best, "left").withColumn("copies", F.expr("copies + if(row = fixed, more, 0)"))
    return out.select(*carry, "doc_id", "size", "source_size", "target", "rate", "copies", F.expr("cast(copies * size as bigint)").alias("taken"))
