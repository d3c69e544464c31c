"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.llm.common import table

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketch rows (some 16 MB), and bytes of item text (five times that as shingles), up to which the benchmark is broadcast;
#: beyond either the joins are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 8 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _windows(tokens: Column, width: int, make) -> Column:
    """make(tokens, i) for each window's first index i; the tokens are evaluated once, as a lambda's variable."""
    return F.flatten(
        F.transform(
            F.array(tokens),
            lambda ws: F.when(
                F.size(ws) >= width, F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: make(ws, i))
            ).otherwise(F.array()),
        )
    )


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """The distinct shingles as strings."""
    return F.array_distinct(_windows(words(text), width, lambda ws, i: F.array_join(F.slice(ws, i + 1, width), " ")))


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """A 64-bit hash of each shingle, by the hashes of its words; repeats stay."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return _windows(hashed, width, lambda hs, i: F.xxhash64(*(F.get(hs, i + j) for j in range(width))))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, n, hash): each item's smallest shingle hashes, as many as its size partition needs.

    Partition p holds items of 2**p to 2**(p+1) - 1 distinct shingles.  A document with the share ``threshold`` of an
    item's shingles lacks n - ceil(threshold * n) of them at most, so of one hash more than that it has one.  The
    partition's largest size sets the sketch length for all its items: no document is missed.
    """
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    length = (largest - F.ceil(largest * threshold) + 1).cast("int")
    smallest = F.slice(F.array_sort(F.array_distinct(F.col("hashes"))), F.lit(1), length)
    return items.select("item", "n", F.explode(smallest).alias("hash"))


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, threshold: float, broadcast_rows: int) -> DataFrame:
    """(id, row_key, item_id, item_shingles, shared) of each row of docs and each item that it holds; see contained_items()."""
    items = (
        benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
        .select("item_id", F.octet_length("item_text").alias("bytes"), shingles(F.col("item_text")).alias("grams"), shingle_hashes(F.col("item_text")).alias("hashes"))
        .withColumn("n", F.size("grams")).filter("n > 0")
        .withColumn("item", F.xxhash64("item_id", "grams"))
    )
    sketch = sketches(items, threshold)
    fits = sketch.limit(broadcast_rows + 1).count() <= broadcast_rows
    fits = fits and items.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] <= BROADCAST_BYTES
    near = F.broadcast if fits else (lambda df: df)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    body = docs.select(own.alias("id"), F.xxhash64(own, text).alias("row_key"), text.alias("body"))  # rows alike in id and text share a key
    hashed = body.select(*(body.columns if fits else ("id", "row_key")), F.explode(shingle_hashes(F.col("body"))).alias("hash"))
    met = hashed.join(near(sketch.select("hash", "item").distinct()), "hash")
    if fits:
        candidates = met.groupBy("id", "row_key", "body").agg(F.collect_set("item").alias("found"))
    else:
        found = met.groupBy("row_key").agg(F.collect_set("item").alias("found"))
        candidates = body.join(found, "row_key")
    listed = candidates.select("id", "row_key", shingles(F.col("body")).alias("doc_grams"), "found").select("id", "row_key", "doc_grams", F.explode("found").alias("item"))
    shared = listed.join(near(items.select("item", "item_id", "n", "grams")), "item").select(
        "id", "row_key", "item_id", F.col("n").cast("long").alias("item_shingles"), F.size(F.array_intersect("grams", "doc_grams")).cast("long").alias("shared")
    )
    return shared.filter(F.col("shared") >= F.col("item_shingles") * threshold)


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = CONTAINMENT,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Items whose share ``threshold`` or more of distinct five-word shingles a document holds, anywhere in it.

    Returns id, item_id, item_shingles, shared, containment: one row for each pair of ids.  Words are lower-case runs of
    letters and digits.  Null text counts as empty; an item of fewer than five words has no shingle and is never found,
    and so is nothing in a document of fewer.  Where an id repeats, its best match is given.  Empty tables give an empty
    result; other columns play no part.

    With a benchmark of a size that is checked, each document's shingle hashes meet the sketches inside the scan's own
    stage; only candidates move on, once each, with their text.  Beyond that size hashes alone are shuffled, and the text
    is fetched for the candidates.  These are verified by their shingles as strings.
    """
    best = F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("containment"), "shared", "item_shingles"))
    found = _matches(docs, benchmark, id_col, text_col, threshold, broadcast_rows).groupBy("id", "item_id").agg(best.alias("b"))
    return found.select(F.col("id").alias(id_col), "item_id", "b.item_shingles", "b.shared", "b.containment")


def clean_rows(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs in which no item is found, with the columns of docs.

    Rows are judged one by one: a row stays if its own text is clean, whatever other rows of its id hold.  Null ids and
    repeated rows are rows like any other; a null text is clean.
    """
    leaked = _matches(docs, benchmark, "doc_id", "text", CONTAINMENT, broadcast_rows).select(F.col("id").alias("leaked_id"), F.col("row_key").alias("leaked_key")).distinct()
    marked = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", "text").alias("own_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("own_id").eqNullSafe(F.col("leaked_id")) & (F.col("own_key") == F.col("leaked_key"))
    return marked.join(leaked, same, "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') FROM benchmark
), g AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i:i+4], ' ') AS gram
  FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), n AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, max(n.n) AS item_shingles, count(*) AS shared, count(*) / max(n.n)::DOUBLE AS containment
FROM g AS i JOIN g AS d ON d.kind = 'd' AND i.kind = 'i' AND d.gram = i.gram JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * max(n.n)
"""
