"""A data source for evidence: a manifest binds every file by size and digest; tasks read and write the files, the driver the manifest.

    register(spark)
    df.write.format("evidence").mode("append").save(path)
    spark.read.format("evidence").option("split", '["discovery"]').load(path)

Splits and kinds are chosen by options, before any file is opened, and not by pushed filters: Spark 4.1 keeps the filters that
the first query of a DataFrame pushed into a Python source for all its later queries, which would then lack rows.

Paths are local ones or URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ablatrix import limits
from ablatrix.errors import InvalidEvidence
from ablatrix.functions.expressions import HEX_DIGEST
from ablatrix.functions.strict_json import strict_loads
from ablatrix.shipping import ship
from ablatrix.sources.sinks import canonical_bytes, sensitive_columns

FORMAT, MANIFEST = "evidence", "MANIFEST.json"
#: Columns whose value is one and the same in a file, so that the manifest tells which files a filter needs.
ROLES = ("split", "kind")
#: Arrow bytes of a file's rows, and of all rows that a writing task holds, before they are written.
FILE, HELD = 4 * limits.MIB, 64 * limits.MIB


@dataclass(frozen=True)
class Entry:
    path: str
    bytes: int
    sha256: str
    roles: dict = field(default_factory=dict)


@dataclass
class Written(WriterCommitMessage):
    entries: list[Entry]


class EntryPartition(InputPartition):
    def __init__(self, entry: Entry):
        super().__init__(entry.path)
        self.entry = entry


class Store:
    """The folder of a bundle, wherever it is."""

    def __init__(self, root: str):
        from pyarrow import fs

        if "://" in root or root.startswith("file:"):
            self.fs, self.root = fs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = fs.LocalFileSystem(), os.path.abspath(root)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(self.at(path)).is_file

    def names(self, most: int) -> list[str]:
        """Every file below the folder, relative to it; hidden ones, which checksums of file systems are, aside."""
        from pyarrow import fs

        found = []
        for info in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True)):
            name = os.path.relpath(info.path, self.root)
            if self.local and os.path.islink(info.path):
                raise InvalidEvidence("artifact_is_link", name)
            if info.is_file and not os.path.basename(name).startswith("."):
                found.append(name)
            if len(found) > most + 1:
                raise InvalidEvidence("bundle_too_many_entries", str(most))
        return found

    def read(self, path: str, most: int) -> bytes:
        """At most one byte more than that, so that a larger file shows without being read."""
        if self.local and os.path.islink(self.at(path)):
            raise InvalidEvidence("artifact_is_link", path)
        try:
            with self.fs.open_input_stream(self.at(path)) as f:
                return f.read(most + 1)
        except FileNotFoundError:
            raise InvalidEvidence("artifact_missing", path) from None

    def write(self, path: str, content: bytes) -> None:
        self.fs.create_dir(os.path.dirname(self.at(path)), recursive=True)
        with self.fs.open_output_stream(self.at(path)) as f:
            f.write(content)

    def write_once(self, path: str, content: bytes) -> None:
        """Whole or not at all, and never over another."""
        spare = f".{path}.{uuid.uuid4().hex}"
        self.write(spare, content)
        try:
            if self.local:
                os.link(self.at(spare), self.at(path))
            elif self.exists(path):
                raise FileExistsError(path)
            else:
                self.fs.copy_file(self.at(spare), self.at(path))
        except FileExistsError:
            raise InvalidEvidence("evidence_already_published", self.root) from None
        finally:
            self.fs.delete_file(self.at(spare))

    def remove(self, paths: Iterable[str]) -> None:
        for path in paths:
            if self.exists(path):
                self.fs.delete_file(self.at(path))


def _limit(options, name: str, default: int) -> int:
    return int(options.get(name, default))


def bound_entries(manifest: dict, options) -> list[Entry]:
    """The entries of a manifest, each of a path inside the bundle, once, and within the limits."""
    listed = manifest.get("artifacts")
    if not isinstance(listed, list):
        raise InvalidEvidence("manifest_malformed", "artifacts")
    if len(listed) > _limit(options, "maxEntries", limits.ENTRIES):
        raise InvalidEvidence("bundle_too_many_entries", str(len(listed)))
    entries, total = {}, 0
    for item in listed:
        if not isinstance(item, dict) or not isinstance(item.get("path"), str):
            raise InvalidEvidence("manifest_malformed", "entry")
        path, size = PurePosixPath(item["path"]), item.get("bytes")
        if path.is_absolute() or ".." in path.parts or not path.parts or str(path) != item["path"] or "\\" in item["path"]:
            raise InvalidEvidence("artifact_path", item["path"])
        if item["path"] in entries:
            raise InvalidEvidence("artifact_listed_twice", item["path"])
        if type(size) is not int or size < 0:
            raise InvalidEvidence("artifact_size", item["path"])
        if size > _limit(options, "maxArtifactBytes", limits.ARTIFACT):
            raise InvalidEvidence("artifact_too_large", item["path"])
        if not re.match(HEX_DIGEST, str(item.get("sha256"))):
            raise InvalidEvidence("digest_malformed", item["path"])
        total += size
        entries[item["path"]] = Entry(item["path"], size, item["sha256"], {k: item[k] for k in ROLES if k in item})
    if total > _limit(options, "maxBundleBytes", limits.BUNDLE):
        raise InvalidEvidence("bundle_too_large", str(total))
    return list(entries.values())


def checked(store: Store, entry: Entry) -> bytes:
    """A file's content, which is what the manifest binds."""
    content = store.read(entry.path, entry.bytes)
    if len(content) != entry.bytes:
        raise InvalidEvidence("artifact_size", entry.path)
    if hashlib.sha256(content).hexdigest() != entry.sha256:
        raise InvalidEvidence("artifact_digest", entry.path)
    return content


def _fitted(value: object, kind: pa.DataType) -> object:
    """JSON's objects as pyarrow takes maps."""
    if value is None:
        return None
    if pa.types.is_map(kind) and isinstance(value, dict):
        return [(k, _fitted(v, kind.item_type)) for k, v in value.items()]
    if pa.types.is_list(kind) and isinstance(value, list):
        return [_fitted(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind) and isinstance(value, dict):
        known = {f.name: f.type for f in kind}
        if unknown := value.keys() - known.keys():
            raise InvalidEvidence("field_unknown", ", ".join(sorted(unknown)))
        return {k: _fitted(v, known[k]) for k, v in value.items()}
    return value


def _rows(entry: Entry, content: bytes, schema: pa.Schema) -> pa.Table:
    if entry.path.endswith(".parquet"):
        import pyarrow.parquet as pq

        return pq.read_table(io.BytesIO(content)).select(schema.names).cast(schema)
    lines = [strict_loads(line, limits.nodes(limits.ARTIFACT)) for line in content.decode().split("\n") if line.strip()]
    try:
        return pa.Table.from_pylist([_fitted(x, pa.struct(list(schema))) for x in lines], schema=schema)
    except (pa.ArrowInvalid, pa.ArrowTypeError, AttributeError) as e:
        raise InvalidEvidence("record_malformed", f"{entry.path}: {e}") from e


class EvidenceReader(DataSourceReader):
    """A partition an entry of the chosen roles.  Size and digest are checked by the task that reads the file, before a row of it is seen."""

    def __init__(self, schema: T.StructType, options):
        self.schema, self.options = schema, options
        manifest = _manifest(options)
        self.entries = bound_entries(manifest, options)
        self.wanted = {name: json.loads(options[name]) for name in ROLES if name in options}
        for name in self.wanted:
            if not all(name in e.roles for e in self.entries):
                raise InvalidEvidence("role_unknown", name)

    def partitions(self) -> Sequence[InputPartition]:
        store = Store(self.options["path"])
        found = set(store.names(_limit(self.options, "maxEntries", limits.ENTRIES))) - {MANIFEST}
        bound = {e.path for e in self.entries}
        if unbound := found - bound:
            raise InvalidEvidence("artifact_unbound", min(unbound))
        if lost := bound - found:
            raise InvalidEvidence("artifact_missing", min(lost))
        return [EntryPartition(e) for e in self.entries if all(e.roles[k] in v for k, v in self.wanted.items())] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if partition.value is None:
            return
        entry = partition.entry
        table = _rows(entry, checked(Store(self.options["path"]), entry), schema)
        for name, value in entry.roles.items():
            if name in table.column_names and table.column(name).unique().to_pylist() not in ([], [value]):
                raise InvalidEvidence("role_differs", f"{entry.path}: {name}")
        yield from table.to_batches()


class EvidenceWriter(DataSourceArrowWriter):
    """Tasks write files of one split and kind under names of their own; commit lists them in the manifest, the last thing written."""

    def __init__(self, schema: T.StructType, options):
        self.schema, self.options = schema, options
        self.store_path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        store, entries, held = Store(self.store_path), [], {}
        most = _limit(self.options, "maxArtifactBytes", limits.ARTIFACT)

        def put(roles: tuple, table: pa.Table) -> None:
            sink = io.BytesIO()
            pq.write_table(table, sink, compression="zstd")
            content = sink.getvalue()
            if len(content) > most and table.num_rows > 1:
                half = table.num_rows // 2
                put(roles, table.slice(0, half))
                put(roles, table.slice(half))
                return
            if len(content) > most:
                raise InvalidEvidence("artifact_too_large", str(len(content)))
            entry = Entry(f"part-{uuid.uuid4().hex}.parquet", len(content), hashlib.sha256(content).hexdigest(), dict(roles))
            entries.append(entry)
            store.write(entry.path, content)

        def flush(roles: tuple) -> None:
            put(roles, pa.Table.from_batches(held.pop(roles)))

        size = lambda roles: sum(b.nbytes for b in held[roles])
        try:
            for batch in iterator:
                for roles, part in _by_role(batch):
                    held.setdefault(roles, []).append(part)
                    if size(roles) >= FILE:
                        flush(roles)
                while held and sum(map(size, held)) > HELD:
                    flush(max(held, key=size))
            for roles in list(held):
                flush(roles)
        except BaseException:
            store.remove(e.path for e in entries)
            raise
        return Written(entries)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store = Store(self.store_path)
        entries = sorted((e for m in messages if m for e in m.entries), key=lambda e: e.path)
        listed = [{"path": e.path, "bytes": e.bytes, "sha256": e.sha256} | e.roles for e in entries]
        manifest = {"schema": json.loads(self.schema.json()), "artifacts": listed}
        bound_entries(manifest, self.options)
        kept = {e.path for e in entries}
        store.remove(n for n in store.names(10 * limits.ENTRIES) if re.fullmatch(r"part-[0-9a-f]{32}\.parquet", n) and n not in kept)  # of tasks that were lost
        store.write_once(MANIFEST, canonical_bytes(manifest))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Store(self.store_path).remove(e.path for m in messages if m for e in m.entries)


def _by_role(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each combination of the columns in ROLES that a batch has."""
    names = [n for n in ROLES if n in batch.schema.names]
    if not names:
        yield (), batch
        return
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
        rows.setdefault(tuple(zip(names, key)), []).append(i)
    for roles, at in rows.items():
        yield roles, batch.take(pa.array(at))


def _manifest(options) -> dict:
    content = Store(options["path"]).read(MANIFEST, limits.ARTIFACT)
    if len(content) > limits.ARTIFACT:
        raise InvalidEvidence("artifact_too_large", MANIFEST)
    manifest = strict_loads(content.decode(), limits.nodes(limits.ARTIFACT))
    if not isinstance(manifest, dict):
        raise InvalidEvidence("manifest_malformed", "root")
    return manifest


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        found = _manifest(self.options).get("schema")
        if found is None:
            raise InvalidEvidence("manifest_without_schema", self.options["path"])
        return T.StructType.fromJson(found)

    def reader(self, schema: T.StructType) -> EvidenceReader:
        return EvidenceReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> EvidenceWriter:
        if found := sensitive_columns(schema):
            raise InvalidEvidence("evidence_contains_sensitive_key", ", ".join(found))
        if overwrite or Store(self.options["path"]).exists(MANIFEST):
            raise InvalidEvidence("evidence_already_published", self.options["path"])
        return EvidenceWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(EvidenceSource)


def publish_evidence(df: DataFrame, path: str, **options: int) -> None:
    """Write a table as evidence, once."""
    register(df.sparkSession)
    df.write.format(FORMAT).options(**options).mode("append").save(path)


def evidence(spark: SparkSession, path: str, schema: T.StructType | str | None = None, split: Sequence[str] = (), kind: Sequence[str] = (), **options: int) -> DataFrame:
    """Rows of evidence, of the given splits and kinds if any are given: then files of others are not opened."""
    register(spark)
    chosen = {name: json.dumps(list(values)) for name, values in (("split", split), ("kind", kind)) if values}
    reader = spark.read.format(FORMAT).options(**options, **chosen)
    return (reader.schema(schema) if schema is not None else reader).load(path)
