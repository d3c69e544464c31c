"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor kept, with the columns of documents, and its decisions take effect; the last gives
the packed pieces.  run() works on documents and needs no intermediate files; a driver may write each stage's result as
Parquet and read it again instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ablatrix.llm import decontaminate, exact_dedup, packing, quality, simhash
from ablatrix.llm.common import checkpointed, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier keeps, fitted on the labels of sf_dir.

    Rows are judged one by one, null and repeated ids too; a null or empty text is judged as an empty one.  Where too few
    labels belong to rows of docs to fit a model, and for an empty table, all rows stay.
    """
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows equal in text, A-Z in lower case, the one of the largest id.

    Null counts as the empty text.  A null id is smaller than any other; of rows equal in id and text one stays.
    """
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints connect, one: that of the smallest id.

    A null id is taken only where no other row of its group has one; of rows equal in id and text one stays.  Texts without
    words share fingerprint zero and so are one group.
    """
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item.

    Rows are judged one by one, null and repeated ids too; a null text and an empty benchmark leave a row alone.
    """
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences: one row a piece.

    A null text is an empty one and gives a piece of its closing id alone; null and repeated ids are rows of their own; an
    empty table gives no pieces.
    """
    return packing.pack(docs, packing.word_bpe_tokens())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the packing have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
