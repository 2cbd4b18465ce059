"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.llm import language_id as lid
from stepframe.llm._shared import materialize, table
from stepframe.llm.line_dedup import line_dedup
from stepframe.llm.mixing import mix
from stepframe.llm.ngram_join import ngram_join
from stepframe.llm.packing import best_fit_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: A document goes if its language's probability is under this many times that of a blind guess.
OVER_CHANCE = 1.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the predicted language to ``lang`` and drop the documents that have none.

    Those are null texts, texts without a letter, and texts that the network can't tell from any language:
    its best score is under OVER_CHANCE times one over the number of languages. Where no document is
    labelled nothing can be learnt; all texts with a letter stay then, as they are.
    """
    model = lid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    known = lid.identify(docs, model).where((F.col("lang_pred") != lid.UNDETERMINED) & (F.col("score") >= OVER_CHANCE / len(model.langs)))
    return known.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in COLUMNS])


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines of at least 20 characters that 3 documents share from all but the last of them."""
    out = line_dedup(docs)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their 5-word shingles the one of least id stays.

    Rows that are equal in every column are one; rows without an id can't be named and all stay.
    """
    joined = ngram_join(docs.select("doc_id", "text"), n=5, percent=80)
    first = joined.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").select(*COLUMNS).distinct()
    return named.union(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that each source comes near its target of words."""
    out = mix(docs.select(*COLUMNS))
    return out.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack whole documents into sequences of 512 to 4096 words."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't train the language model, nor pack; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
