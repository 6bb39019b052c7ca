"""The corpus pipeline: toxicity, language ID, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, extra ones too. The
classifiers are fitted on the rows that the stage is given; labels come from sf_dir.

Defined results, of every stage: no rows give no rows; rows pass unchanged or not at all; a null id is an id
like others; very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bitvane.llm import exact_dedup, lang_id, near_dedup, packing, toxicity
from bitvane.llm._spark import kept, scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the calibrated classifier doesn't call toxic.

    Null and empty texts are scored as texts without words; repeated rows go or stay together; without labels of
    both kinds all rows stay.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which two fifths or more are in one learned language; other mixtures and texts without letters go.

    Null and empty texts have no letters; repeated rows go or stay together; where no row has a language, all go.
    """
    return lang_id.keep_identified(docs, lang_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row of the largest doc_id.

    Null and empty texts are equal; of rows with the same text and id one stays; a null id only where no row of
    the text has another.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8), the row of the least doc_id.

    Texts without words are copies of each other; of rows with the same words and id one stays; a null id only
    where no row of the class has another.
    """
    return near_dedup.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id; rows that repeat are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]
#: No stage but the third can be put in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; what a stage wrote on its way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
