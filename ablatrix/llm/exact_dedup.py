"""Exact dedup: skew-safe combining of equal texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ablatrix.llm.common import LOWER, UPPER, ascii_lower, checkpointed, look_up, table

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
    carry: bool = False,
) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z; the row with the largest id stays.

    1. Locally, a map-side aggregate keyed by digest, salt and full text leaves one row a text and salt in each task.
    2. Salted digest groups merge these, again keyed by the full text; the salt hashes the id, so that copies of one
       text, however many, spread over ``salts`` groups.
    3. The salt winners, at most ``salts`` a text, combine globally, keyed by digest and full text.
    Each document then looks its group up by digest.  A digest that turned out to hold several different texts is looked
    up by its full text instead.

    Returns id, keep_id, group_size, kept, text_sha256, after these with ``carry`` all columns of docs as a struct
    ``row``.  Null text counts as empty; a null id is smaller than any other.  Of rows equal in id and text exactly one
    is kept.  An empty table gives an empty result.  Other columns, whatever their names, play no part.
    """
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    base = docs.select(F.col(f"`{id_col}`").alias("id"), ascii_lower(F.col(f"`{text_col}`")).alias("body"), *own)
    base = base.withColumn("digest", digest(F.col("body")))
    salted = (
        base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "body")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    )
    merged = salted.repartition("digest").groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = merged.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.count("*").alias("texts"))
    groups = checkpointed(groups)
    total, mixed = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("texts"), F.lit(1))).first()
    rows = base.withColumn("text_sha256", F.col("digest") if digest is sha256 else sha256(F.col("body")))
    if mixed == 1:
        found = look_up(rows.drop("body"), groups.drop("texts"), "digest", "n", total, F.col("id"))
    else:
        found = look_up(rows, merged.drop("digest"), "body", "n", total, F.col("id"))
    order = F.xxhash64("row") if carry else F.lit(0)
    first = F.row_number().over(Window.partitionBy("join_key", "id").orderBy(order)) == 1
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with the columns of docs."""
    return exact_dedup(docs, carry=True, **options).filter("kept").select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
