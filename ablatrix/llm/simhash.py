"""SimHash near-dedup: pigeonhole blocks over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ablatrix.llm.common import checkpointed, components, look_up, parts, ship, table

SHINGLE = 4
DISTANCE = 4
#: Buckets of at most so many fingerprints are joined with themselves; larger ones are compared in tiles of TILE rows.
BUCKET, TILE = 64, 512

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # byte value -> its bits, high first


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    width = min(shingle, len(words))
    hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :])], dtype=">u8")
    octets = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes)).tobytes(), "big")


def fingerprints(text: Column) -> Column:
    """fingerprint() of each text as a signed long; other columns of the row do not pass through Python."""
    return F.arrow_udf(_fingerprints, "long")(text)


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        values = [fingerprint(t) for texts in parts(batch) for t in texts]
        yield pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _block_keys(blocks: int, distance: int) -> list[Column]:
    """One key for each choice of blocks - distance blocks: fingerprints within the distance agree in one of them at least."""
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key, width = F.lit(0).cast("long"), 0
        for b in chosen:
            size = bounds[b + 1] - bounds[b]
            part = F.shiftrightunsigned("fp", bounds[b]).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            key, width = key.bitwiseOR(F.shiftleft(part, width)), width + size
        keys.append(F.struct(F.lit(number).alias("choice"), key.alias("key")))
    return keys


def _tile_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of one tile's links: each fingerprint with the smallest one that it reaches inside the tile."""
    codes = np.unique(pdf["fp"].to_numpy())
    distance = int(pdf["distance"].iloc[0]) if len(pdf) else 0
    near = np.bitwise_count(codes.view(np.uint64)[:, None] ^ codes.view(np.uint64)[None, :]) <= distance
    label = np.arange(len(codes))
    while True:
        lower = np.where(near, label[None, :], len(codes)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(len(codes))
    return pd.DataFrame({"u": codes[moved], "v": codes[label[moved]]})


def links(codes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, blocks: int | None = None) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp`` whose connected components are those of all links within distance.

    The number of blocks follows the number of fingerprints, so that a random bucket stays small.  Small buckets give
    their verified pairs.  A larger bucket is cut into chunks; each pair of chunks is one task group of bounded size,
    which compares all its rows and returns a spanning forest only, so no bucket emits its pairs.
    """
    if blocks is None:
        count, blocks = codes.count(), distance + 2
        while count > 1 << (64 * (blocks - distance) // blocks + 1):
            blocks += 1
    dealt = codes.select("fp", F.explode(F.array(*_block_keys(blocks, distance))).alias("k"))
    dealt = dealt.select("fp", "k.choice", "k.key", F.concat_ws("/", "k.choice", "k.key").alias("bucket"))
    sizes = checkpointed(dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = look_up(dealt, sizes, "bucket", "n", total, F.col("fp")).filter("n IS NOT NULL")
    small = dealt.filter(F.col("n") <= bucket).select("choice", "key", "fp")
    other = small.withColumnRenamed("fp", "other")
    close = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
    pairs = small.join(other, ["choice", "key"]).filter(close).select(F.col("other").alias("u"), F.col("fp").alias("v"))
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    large = (
        dealt.filter(F.col("n") > bucket)
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("choice", "key", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "fp", F.lit(distance).alias("distance"))
    )
    tiles = large.groupBy("choice", "key", "low", "high").applyInPandas(_tile_links, "u long, v long")
    return pairs.unionByName(tiles).distinct()


def _grouped(rows: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, int]:
    """(fp, root, component_id, n) of each fingerprint of rows(id, fp), root a component's own name, and the number of rows."""
    codes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    total = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reach = components(links(codes.select("fp"), distance))
    codes = codes.join(reach.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = checkpointed(codes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("codes")))
    found = look_up(codes, least, "root", "codes", codes.count(), F.col("fp"))
    return found.select("fp", "root", "component_id", "n"), total


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Fingerprint every text and group the rows whose fingerprints connect at ``distance`` or fewer differing bits.

    Returns id, fingerprint (16 hex digits), component_id (smallest id of the group).  A null or wordless text has
    fingerprint zero and links like any other.  Rows are grouped by fingerprint first: copies, however many, are one node.
    Repeated ids are rows of their own; a null id never is a component_id unless its whole group has none.  An empty table
    gives an empty result; texts of any length are read whole; other columns play no part.
    """
    ship(docs.sparkSession)
    rows = checkpointed(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprints(F.col(f"`{text_col}`")).alias("fp")))
    found, total = _grouped(rows, distance)
    out = look_up(rows, found, "fp", "n", total, F.col("id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of docs for each component: that of its smallest id; where several rows have that id, one of them.

    A null id is taken only where the whole component has no other.  Rows equal in all columns count as several.  Texts
    pass through Python once, for their fingerprints, and rows not at all.
    """
    ship(docs.sparkSession)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.xxhash64(own, text)
    rows = checkpointed(docs.select(own.alias("id"), key.alias("row_key"), fingerprints(text).alias("fp")))
    found, total = _grouped(rows, distance)
    first = look_up(rows, found, "fp", "n", total, F.col("id")).filter(F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root").agg(F.first("component_id").alias("first_id"), F.min("row_key").alias("first_key"))
    marked = docs.select(own.alias("own_id"), key.alias("own_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = marked.join(first, F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_key") == F.col("first_key")))
    number = F.row_number().over(Window.partitionBy("own_id", "own_key").orderBy(F.lit(0)))
    return kept.withColumn("number", number).filter("number = 1").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
