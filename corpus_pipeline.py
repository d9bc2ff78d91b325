"""A training-data pipeline over ``documents``: five stages, each one operator.

Every stage works on all rows its predecessor kept and all but the last return
the columns of ``documents``.  Importing this module needs ``larkspur.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import lines, mixing, packing, simhash, toxicity
from larkspur.llm.common import delete, scratch, set_aside, stored, table
from larkspur.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores below 0.5; null texts count as empty."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, freed of later copies of long lines and of runs of lines; n_chars follows the text.

    Null texts stay null, and other columns as they are whatever their names.
    """
    own, now = set_aside(docs, ("n_lines", "n_removed"))
    out = lines.remove_repeated_lines(own).select(*[F.col(f"`{now[c]}`").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of their five-word shingles alike, by SimHash.

    Texts without words, null ones too, are copies of one another; rows without
    an id stay, and columns as they are whatever their names.
    """
    return simhash.keep_one(docs, seen=simhash.near_copies(docs, width=5, similarity=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for; null texts have no words and are not taken."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, copies included, with their places in training sequences; a null text is the end token alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_lines),
    ("SimHash near-dedup", keep_distinct),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifier's stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and reread.

    What a stage wrote on its way goes once its result is there, and a stage's
    result once the next one's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            result = made.pop()
        if before:
            delete(spark, before)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
