"""N-dimensional arrays as rows (i0, i1, ..., value): .npz and .npy files are read by ranges of their bytes, and written in blocks.

A header says kind, order and shape; what the values are is never guessed, and objects are never unpickled.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.errors import InvalidEvidence
from ablatrix.shipping import ship
from ablatrix.sources.bundle import Store
from ablatrix.sources.sinks import canonical_bytes

#: Values that a task reads at a time, and those of a block that is written as one file.
STEP, BLOCK = 1 << 18, 1 << 22
#: Bytes of a file's end in which a ZIP archive's directory is looked for, and of an array's header.
TAIL, HEADER = 1 << 20, 1 << 16
INDEX = "ARRAY.json"


@dataclass(frozen=True)
class Layout:
    """Where an array's values are: a file, the place of the first, their kind and shape, the first index fastest or slowest."""

    path: str
    start: int
    kind: str
    shape: tuple[int, ...]
    fortran: bool


def _part(store: Store, path: str, start: int, length: int) -> bytes:
    with store.fs.open_input_file(store.at(path)) as f:
        return f.read_at(length, start)


def _member(store: Store, path: str, name: str) -> int:
    """Where an archive's uncompressed member begins."""
    import zipfile

    size = store.fs.get_file_info(store.at(path)).size
    with store.fs.open_input_file(store.at(path)) as f:  # the directory alone is read
        try:
            listed = {i.filename: i for i in zipfile.ZipFile(io.BufferedReader(f, TAIL)).infolist()}
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise InvalidEvidence("array_archive_malformed", path) from e
    found = listed.get(f"{name}.npy")
    if found is None:
        raise InvalidEvidence("array_missing", f"{path}: {name}")
    if found.compress_type != zipfile.ZIP_STORED:
        raise InvalidEvidence("array_compressed", f"{path}: {name}")
    local = _part(store, path, found.header_offset, 30)
    if len(local) < 30 or local[:4] != b"PK\x03\x04":
        raise InvalidEvidence("array_archive_malformed", path)
    begin = found.header_offset + 30 + sum(struct.unpack("<HH", local[26:30]))
    if begin + found.file_size > size:
        raise InvalidEvidence("array_archive_malformed", path)
    return begin


def layout(root: str, path: str, name: str | None = None, shape: Sequence[int] | None = None) -> Layout:
    """The layout of a .npy file, or of an .npz archive's member; refused if the shape isn't the wanted one."""
    from numpy.lib import format as npy

    store = Store(root)
    begin = 0 if name is None else _member(store, path, name)
    head = io.BytesIO(_part(store, path, begin, HEADER))
    try:
        version = npy.read_magic(head)
        found, fortran, kind = npy.read_array_header_1_0(head) if version == (1, 0) else npy.read_array_header_2_0(head)
    except ValueError as e:
        raise InvalidEvidence("array_header_malformed", path) from e
    if kind.hasobject or kind.kind not in "fiub":
        raise InvalidEvidence("array_kind", f"{path}: {kind}")
    if shape is not None and tuple(shape) != tuple(found):
        raise InvalidEvidence("array_shape", f"{path}: {tuple(found)}, not {tuple(shape)}")
    start = begin + head.tell()
    if store.fs.get_file_info(store.at(path)).size < start + prod(found) * kind.itemsize:
        raise InvalidEvidence("array_truncated", path)
    return Layout(path, start, kind.str, tuple(found), bool(fortran))


def _columns(shape: tuple[int, ...], flat: np.ndarray, values: np.ndarray, fortran: bool) -> pa.RecordBatch:
    places = np.unravel_index(flat, shape, order="F" if fortran else "C") if shape else ()
    names = [f"i{k}" for k in range(len(shape))]
    return pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int64)) for p in places), pa.array(values)], [*names, "value"])


def read_array(spark: SparkSession, root: str, path: str, name: str | None = None, shape: Sequence[int] | None = None, parts: int | None = None) -> DataFrame:
    """Rows (i0, i1, ..., value) of an array; each task reads a range of its bytes and no others."""
    ship(spark)
    found = layout(root, path, name, shape)
    kind = np.dtype(found.kind)
    out = {"f": "double", "i": "long", "u": "long", "b": "boolean"}[kind.kind]
    to = {"f": np.float64, "i": np.int64, "u": np.int64, "b": np.bool_}[kind.kind]
    total = prod(found.shape)
    parts = parts or max(1, min(spark.sparkContext.defaultParallelism, -(-total // STEP)))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                low, high = part * total // parts, (part + 1) * total // parts
                for a in range(low, high, STEP):
                    n = min(STEP, high - a)
                    content = _part(store, found.path, found.start + a * kind.itemsize, n * kind.itemsize)
                    if len(content) != n * kind.itemsize:
                        raise InvalidEvidence("array_truncated", found.path)
                    yield _columns(found.shape, np.arange(a, a + n), np.frombuffer(content, kind).astype(to), found.fortran)

    fields = ", ".join([*(f"i{k} long" for k in range(len(found.shape))), f"value {out}"])
    return spark.range(0, parts, 1, parts).mapInArrow(values, fields)


def write_array(df: DataFrame, root: str, shape: Sequence[int], indices: Sequence[str], value: str = "value", block: int = BLOCK) -> list[dict]:
    """Write rows as .npy blocks of the array's values in order, each with its digest, and an index of blocks last.

    Every place of the shape has one row.  A block is put in order and checked by one task as it goes along; nothing is
    held but the block.  Refused: a place that is missing, twice there or outside the shape, a null, an index that exists.
    """
    ship(df.sparkSession)
    shape, store = tuple(int(n) for n in shape), Store(root)
    if len(shape) != len(indices) or any(n < 1 for n in shape):
        raise InvalidEvidence("array_shape", str(shape))
    if store.exists(INDEX):
        raise InvalidEvidence("evidence_already_published", root)
    flat, inside = F.lit(0).cast("long"), F.lit(True)
    for n, c in zip(shape, indices):
        flat, inside = flat * n + F.col(c), inside & F.coalesce((F.col(c) >= 0) & (F.col(c) < n), F.lit(False))
    rows = df.select(F.when(inside, flat).otherwise(F.raise_error(F.lit("array_place_outside"))).cast("long").alias("flat"), F.col(value).cast("double").alias("value"))
    total = prod(shape)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, [], []

        def put() -> None:
            if at is None:
                return
            places, numbers = (np.concatenate(c) for c in zip(*held))
            low = at * block
            if not np.array_equal(places, np.arange(low, min(low + block, total))):
                raise InvalidEvidence("array_places", f"block {at}")
            if np.isnan(numbers).any():
                raise InvalidEvidence("array_value_missing", f"block {at}")
            sink = io.BytesIO()
            np.save(sink, numbers, allow_pickle=False)
            content = sink.getvalue()
            Store(root).write(f"block-{at:08}.npy", content)
            done.append((at, len(content), hashlib.sha256(content).hexdigest()))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            places, numbers = batch.column("flat").to_numpy(), batch.column("value").to_numpy(zero_copy_only=False)
            for b in np.unique(places // block):
                if b != at:
                    put()
                    at, held = int(b), []
                here = places // block == b
                held.append((places[here], numbers[here]))
        put()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["block", "bytes", "sha256"])

    dealt = rows.withColumn("block", F.floor(F.col("flat") / block)).repartition("block").sortWithinPartitions("flat").select("flat", "value")
    found = sorted(tuple(r) for r in dealt.mapInArrow(written, "block long, bytes long, sha256 string").collect())
    if [b for b, *_ in found] != list(range(-(-total // block))):
        raise InvalidEvidence("array_places", "a block is missing")
    listed = [{"path": f"block-{b:08}.npy", "bytes": n, "sha256": sha} for b, n, sha in found]
    store.write_once(INDEX, canonical_bytes({"shape": list(shape), "block": block, "blocks": listed}))
    return listed


def read_blocks(spark: SparkSession, root: str, shape: Sequence[int] | None = None) -> DataFrame:
    """Rows (i0, i1, ..., value) of write_array(): a task a block, its digest checked first."""
    ship(spark)
    index = json.loads(Store(root).read(INDEX, 1 << 24))
    found = tuple(index["shape"])
    if shape is not None and tuple(shape) != found:
        raise InvalidEvidence("array_shape", f"{found}, not {tuple(shape)}")
    blocks = spark.createDataFrame([(i, b["path"], b["bytes"], b["sha256"]) for i, b in enumerate(index["blocks"])], "block long, path string, bytes long, sha256 string")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for row in batch.to_pylist():
                content = store.read(row["path"], row["bytes"])
                if len(content) != row["bytes"] or hashlib.sha256(content).hexdigest() != row["sha256"]:
                    raise InvalidEvidence("artifact_digest", row["path"])
                numbers = np.load(io.BytesIO(content), allow_pickle=False)
                low = row["block"] * index["block"]
                for a in range(0, len(numbers), STEP):
                    some = numbers[a : a + STEP]
                    yield _columns(found, np.arange(low + a, low + a + len(some)), some, False)

    fields = ", ".join([*(f"i{k} long" for k in range(len(found))), "value double"])
    return blocks.repartition(max(len(index["blocks"]), 1)).mapInArrow(values, fields)
