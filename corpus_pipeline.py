"""A corpus pipeline of five stages, each a training-data operator over all that the stage before kept.

Quality rules drop what they reject; of each group of near-duplicates one document stays; personal data is replaced;
sources are mixed to their target shares, so a document may leave or come several times; what remains is packed into
sequences. All stages but the last return the columns of ``documents``; the last returns one row for each piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import mixing, near_dedup, packing, pii, quality
from quillgraph.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rule nor a certified cutoff rejects, as they are.

    Null, empty and blank texts have no words and go. A null id is judged by the rules alone, a null language is a stratum
    of its own. Repeated rows are judged alike, values at a cutoff are rejected, texts of any length count whole. An empty
    table stays empty; further columns of any name come along.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, as it is.

    Null, empty and blank texts and rows with a null id all stay. Of rows that agree in id and text one stays; rows of one
    id with different texts are documents of their own. Long texts count whole. An empty table stays empty; further
    columns of any name come along.
    """
    return near_dedup.one_of_each_group(docs, shingle=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind.

    Null texts stay null and empty ones empty; null ids and repeated rows stay, the latter redacted alike. Overlapping spans
    become one mark, of the first. Long texts are read whole. An empty table stays empty; further columns of any name come along.
    """
    return pii.redacted_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, none to three times.

    Texts without words (null, empty, blank) take nothing and go. A null source is one of its own, the last. Identical rows
    share their hash and get the same copies; reruns agree. An empty table stays empty; further columns of any name come along.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place.

    A null or empty text is one piece, the end token. Null ids and repeated rows are packed each on its own. A long text is
    cut into pieces of a whole sequence, the first may be shorter. An empty table gives no rows; further columns are ignored.
    """
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]
#: The stages fit models, solve for multipliers and search packings, which SQL doesn't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
    return docs
