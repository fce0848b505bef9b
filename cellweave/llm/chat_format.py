"""Chat rendering by perspective rotation, in DataFrame functions only.

For every participant of a dialogue (every role but system) the dialogue is rendered once with that speaker as assistant and all
others as users named by their role; the loss mask covers what the speaker says, up to and including its end mark.  Long
dialogues are rendered in parts of ``PART`` messages, so that no row grows with a dialogue; offsets run on over its parts.

Messages get their places from a distributed sort: each partition numbers its own, and the messages of a dialogue in
earlier partitions are added.  No dialogue, and no group of messages without a turn or a dialogue, is ever in one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def placed_messages(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0 within the dialogue, by turn, nulls last, role and text), role, text."""
    said = turns.select("conv_id", F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "late", "turn", "role", "text"]
    ranged = cut(said.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.monotonically_increasing_id().alias("id")))
    ranged = ranged.withColumn("chunk", F.shiftright("id", 33))
    chunks = ranged.groupBy("conv_id", "chunk").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    chunks = chunks.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk")) - F.col("n")).select(F.col("conv_id").alias("of"), F.col("chunk").alias("in"), "first", "before")
    return ranged.join(chunks, F.expr("conv_id <=> of and chunk = in")).select("conv_id", F.expr("id - first + before").alias("at"), "role", "text")


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_own, start, text, mask, from columns conv_id, turn, role, text.

    One row for each dialogue, participant and part (``PART`` messages each, but for the last) of the dialogue.  start: the
    characters before this part in the whole rendering.  mask: spans start:end of the speaker's words and end marks, in
    characters of the whole rendering, end exclusive, joined by commas.  Within a dialogue, messages are ordered by turn
    (nulls last), role and text; repeated rows are messages of their own.  A null role is the speaker 'unknown', a null text
    is empty, messages with a null conv_id form a dialogue of their own; a dialogue of system messages alone has no participant and
    no row.  Other columns are not read; an empty table gives no rows.
    """
    prepare(turns.sparkSession)
    said = placed_messages(turns)
    parts = said.groupBy("conv_id", F.expr(f"at div {PART}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("msgs"))
    who = said.where("role <> 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    each = parts.join(who, F.expr("conv_id <=> of"))
    head = f"""'{OPEN}' || case when m.role = perspective then 'assistant' when m.role = 'system' then 'system' else 'user name=' || m.role end || '\\n'"""
    each = each.withColumn("lines", F.expr(f"transform(msgs, m -> named_struct('own', m.role = perspective, 'head', {head}, 'body', m.text || '{CLOSE[:-1]}\\n'))"))
    each = each.withColumn("size", F.expr("aggregate(lines, 0L, (n, x) -> n + length(x.head) + length(x.body))"))
    run = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0).cast("bigint")))
    step = "named_struct('at', s.at + length(x.head) + length(x.body), 'spans', if(x.own, concat(s.spans, array((s.at + length(x.head)) || ':' || (s.at + length(x.head) + length(x.body)))), s.spans))"
    mask = F.expr(f"array_join(aggregate(lines, named_struct('at', start, 'spans', cast(array() as array<string>)), (s, x) -> {step}).spans, ',')")
    return each.select(
        "conv_id", "perspective", "part", F.size("msgs").cast("bigint").alias("n_turns"), F.expr("cast(size(filter(lines, x -> x.own)) as bigint)").alias("n_own"), "start",
        F.expr("array_join(transform(lines, x -> x.head || x.body), '')").alias("text"), mask.alias("mask"),
    )
