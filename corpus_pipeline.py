"""A corpus pipeline: filter, deduplicate, mix and pack ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

What every stage does with odd rows: a null text counts as empty; very long texts are read
whole; columns beside ``doc_id``, ``text`` and ``source`` pass untouched, whatever their names;
an empty table gives an empty one. Rows that repeat identifier and text are one document in
several rows: they are scored alike, stay or go together in both deduplicating stages, and
are mixed and packed row by row. Rows without an identifier come after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import exact_dedup, mixing, near_join, pattern_packing, toxicity
from tidewake.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model is trained on this stage's labelled rows.

    Empty texts get the model's bias. Without labels of both kinds the score is the rate of the
    one there is. Equal texts score alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, model).filter(F.col("score") < 0.7).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the smallest identifier stays.

    Empty and null texts are one text. Of texts without any identifier all stay.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group that five-word shingles link (similarity 0.8 or more) one document stays.

    It is the one with the smallest identifier; rows without an identifier and texts without
    words stay.
    """
    return near_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source of its own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their sequence and place; an empty text is its end id alone."""
    return pattern_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the packing can't be told in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows. Each stage's table is written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
