"""A corpus from documents: language, near-duplicates, benchmark leaks, secrets, mixture.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.  ``run`` applies them in turn.

Every stage judges rows, not ids: rows without an id (or with nulls elsewhere) stay unless their own text is turned down.
near_dedup leaves one of the rows that repeat an id and its text; it does not compare rows without an id, nor those of an id
with several texts, which all stay.  The other stages treat repeated rows one by one.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import cut, once_rows, prepare, remove_folder, table, without_rows
from cellweave.llm.decontaminate import contamination
from cellweave.llm.language_id import annotate, held_out, learn
from cellweave.llm.mixing import mix_sources
from cellweave.llm.near_dedup import near_duplicates
from cellweave.llm.secrets import find_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents go if a smaller share of their words than this is known in some language, or has known n-grams of three letters or more.
LEAST_TOLD = 0.2


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with an id of their own, row_id, written to the shared checkpoint folder so that it stays the same."""
    prepare(spark)
    return cut(docs.select(COLUMNS).withColumn("row_id", F.monotonically_increasing_id()))


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").isNull(), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter (und), of null text too, and those in a language that nothing was learned of go.

    Learns from the documents that op9 learns from.  Without any labelled document no language is known, and nothing can be told
    apart: then only documents without a letter go.
    """
    prepare(spark)
    model = learn(docs.where(~held_out()).select("doc_id", "lang", "text"))
    if not model["langs"]:
        return docs.select(COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return annotate(docs.select(COLUMNS), model).where(f"lang_pred <> 'und' and told >= {LEAST_TOLD}").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that with the least id.

    Null and blank texts are near nothing and stay; of rows that repeat an id and its text one stays, that with the least other columns.
    """
    prepare(spark)
    docs = docs.select(COLUMNS)
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(_text_hash()).alias("a"), F.max(_text_hash()).alias("b"))
    repeated = cut(ids.where("n > 1").select("doc_id", F.expr("a <> b").alias("clash")))
    docs = once_rows(docs, repeated.select("doc_id"), "doc_id", ["doc_id", "text"])
    groups = near_duplicates(without_rows(docs, repeated.where("clash").select("doc_id"), "doc_id"), shingle=5, percent=80)
    return without_rows(docs, groups.where("not kept").select("doc_id"), "doc_id").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole window (13 words) of the benchmark, and of shorter items less than one word in 20.

    Null texts stay; an empty benchmark takes nothing away.
    """
    rows = _numbered(spark, docs)
    found = contamination(rows, table(spark, sf_dir, "benchmark"), spans=False, id_col="row_id")
    return without_rows(rows, found.where("n_whole > 0 or contaminated").select(F.col("doc_id").alias("row_id")), "row_id").select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by [SECRET] (n_chars follows); null texts stay null."""
    found = find_secrets(docs.select(COLUMNS), redact=True)
    return found.select("doc_id", F.coalesce("redacted", "text").alias("text"), "lang", "source", F.expr("if(redacted is null, n_chars, length(redacted))").cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with size, copies (1 or 2) and taken (words, repeats counted).

    A null source is a source of its own; texts without words count nothing, and stay as their source's rate has it.
    """
    rows = _numbered(spark, docs)
    mixed = mix_sources(rows, carry=("row_id",)).where("copies > 0").select("row_id", "size", "copies", "taken")
    return rows.join(mixed, "row_id").select(*COLUMNS, "size", "copies", "taken")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]

#: SQL expresses neither the language model nor the Markov models and the Newton iterations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; what lies between them is written to the shared checkpoint folder.

    A stage's folder goes once the next one is written; the last is what the result is read from, and stays.
    """
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if i:
                remove_folder(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
