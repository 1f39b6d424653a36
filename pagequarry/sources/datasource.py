"""``spark.read.format("pagequarry")``: files under a path as one table, and a sink of one file per row.

Reading::

    register(spark)
    spark.read.format("pagequarry").option("table", "objects").load("s3://bucket/corpus").where("kind = 'stream'")
    spark.read.format("pagequarry").schema("doc_id string, page_count int").load(path)

Files are listed once and dealt to partitions by bytes.  A declared schema names the
columns that are wanted; what they do not need is neither parsed nor decoded.
Conditions on ``doc_id`` drop files before they are opened, those on the columns in
``PUSHED`` objects and pages before they are read.  Files are opened one by one as rows
are asked for, so a limit ends early.  Options: ``table``, ``maxStreamSize``,
``password``, ``preview``, ``streamContent``, ``glob``, ``recursive``, ``partitionBytes``.
With ``folders`` true, folders under the path are listed by the tasks that read them, so
the driver holds names of folders only.

Writing: rows (doc_id, json) or (doc_id, content) become files named after their
document.  Tasks write into folders of their own; the commit moves what successful
attempts left, so a failed job leaves nothing and a repeated task nothing twice.
Option ``folders`` spreads files over so many folders by their names; a folder that one
task alone wrote (rows dealt by :func:`folder_of`) is moved as a whole.

Paths go through pyarrow's file systems (local, ``s3``, ``gs``, ``hdfs``).  For other ones
``read_files`` reads with Spark's own reader.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D
from pyspark.sql.types import StringType, StructField, StructType

from pagequarry.operators.dump import DumpOptions
from pagequarry.sources.document import DEFAULT_MAX_STREAM
from pagequarry.sources.scan import PUSHED, SCHEMAS, Only, ScanOptions, batches_of
from pagequarry.workspace import ship

PARTITION_BYTES = 128 << 20
#: What opening a file counts for, beside its bytes.
OPEN_BYTES = 1 << 20
#: Folders that one task lists and reads.
PARTITION_FOLDERS = 8
#: Bytes of files that are handed on at once.
READ_BYTES = 1 << 20
_OPS = {D.EqualTo: "=", D.In: "in", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path on it, and what comes before that path in a document's id."""
    if path.startswith("s3a://"):
        path = "s3://" + path[6:]
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path), "file:"
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner.lstrip("/"))] if path.endswith(inner.lstrip("/")) else ""


def _folder_name(number: int) -> str:
    return f"{number:05d}"


def folder_of(name: Column, folders: int) -> Column:
    """The number of the folder that the sink puts a file in."""
    return F.crc32(name.cast("binary")) % folders


def _files_in(system: pafs.FileSystem, folder: str, recursive: bool) -> list[pafs.FileInfo]:
    found = system.get_file_info(pafs.FileSelector(folder, recursive=recursive, allow_not_found=True))
    return sorted((i for i in found if i.type == pafs.FileType.File), key=lambda i: i.path)


def read_spread(spark: SparkSession, path: str, folders: int, glob: str = "*") -> DataFrame:
    """Files (path, content) that the sink spread over folders; tasks list what they read."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, before = file_system(path)
        packed = lambda: pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "content": pa.array(data, pa.binary())})
        names, data, size = [], [], 0
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            for info in _files_in(system, posixpath.join(root, _folder_name(number)), False):
                if not fnmatchcase(info.base_name, glob):
                    continue
                with system.open_input_stream(info.path) as source:
                    data.append(source.read())
                names.append(before + info.path)
                size += len(data[-1])
                if size >= READ_BYTES or len(data) >= 2_000:
                    yield packed()
                    names, data, size = [], [], 0
        if data:
            yield packed()

    numbers = spark.range(0, folders, 1, max(1, folders // PARTITION_FOLDERS))
    return numbers.mapInArrow(run, "path string, content binary")


@dataclass
class Files(D.InputPartition):
    """The files of a partition: id and path of each; and folders whose files are its own."""

    names: list[tuple[str, str]]
    folders: list[str] = field(default_factory=list)


class PdfReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.given, self.schema = options, schema  # keys are compared without case
        self.table = options.get("table", "documents")
        self.only: list[Only] = []
        self.names: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "doc_id" and isinstance(f, (D.EqualTo, D.In, D.StringStartsWith, D.StringEndsWith, D.StringContains)):
                self.names.append(f)
            elif column in PUSHED.get(self.table, ()) and type(f) in _OPS:
                self.only.append(Only(column, _OPS[type(f)], f.value))
            else:
                yield f

    @property
    def _recursive(self) -> bool:
        return self.given.get("recursive", "true").lower() == "true"

    def _named(self, doc_id: str) -> bool:
        tests = {D.EqualTo: str.__eq__, D.In: lambda a, b: a in b, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: str.__contains__}
        return all(tests[type(f)](doc_id, f.value) for f in self.names)

    def partitions(self) -> list[Files]:
        path, glob = self.given["path"], self.given.get("glob", "*.pdf")
        system, root, before = file_system(path)
        found = system.get_file_info(root)
        apart: list[str] = []
        if found.type == pafs.FileType.Directory:
            spread = self.given.get("folders", "false").lower() == "true"
            found = system.get_file_info(pafs.FileSelector(root, recursive=self._recursive and not spread))
            if spread and self._recursive:
                apart = sorted(i.path for i in found if i.type == pafs.FileType.Directory and i.base_name != "_temporary")
        else:
            found, glob = [found], "*"
        limit = int(self.given.get("partitionBytes", PARTITION_BYTES))
        out: list[Files] = [Files([])]
        size = 0
        for info in sorted((i for i in found if i.type == pafs.FileType.File), key=lambda i: i.path):
            doc_id = before + info.path
            if not fnmatchcase(info.base_name, glob) or not self._named(doc_id):
                continue
            own = (info.size or 0) + OPEN_BYTES
            if out[-1].names and size + own > limit:
                out.append(Files([]))
                size = 0
            out[-1].names.append((doc_id, info.path))
            size += own
        return out + [Files([], apart[k : k + PARTITION_FOLDERS]) for k in range(0, len(apart), PARTITION_FOLDERS)]

    def read(self, partition: Files) -> Iterator:
        system, _, before = file_system(self.given["path"])
        glob = self.given.get("glob", "*.pdf")
        look = DumpOptions(preview=int(self.given.get("preview", DumpOptions().preview)), inline=self.given.get("streamContent", "false").lower() == "true")
        options = ScanOptions(
            int(self.given.get("maxStreamSize", DEFAULT_MAX_STREAM)), self.given.get("password", "").encode(), look,
            columns=tuple(c for c in self.schema.names if c != "doc_id"), only=tuple(self.only),
        )

        def opened(path: str):
            def read() -> bytes:
                with system.open_input_stream(path) as source:
                    return source.read()

            return read

        def names() -> Iterator[tuple[str, str]]:
            yield from partition.names
            for folder in partition.folders:
                for info in _files_in(system, folder, True):
                    if fnmatchcase(info.base_name, glob) and self._named(before + info.path):
                        yield before + info.path, info.path

        inner = StructType([StructField("doc_id", StringType()), *[f for f in self.schema if f.name != "doc_id"]])
        for batch in batches_of(((doc_id, opened(path)) for doc_id, path in names()), self.table, options, inner):
            yield batch.select(self.schema.names)


@dataclass
class Written(D.WriterCommitMessage):
    """The folder of a task's successful attempt."""

    folder: str


class FileWriter(D.DataSourceWriter):
    """One file per row, named after the last part of its document's id."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        self.folders = int(options.get("folders", 0))
        self.place = schema.names.index("doc_id")
        self.value = next(k for k, c in enumerate(schema.names) if c in ("json", "content"))
        system, root, _ = file_system(self.path)
        self.work = posixpath.join(root, "_temporary", uuid.uuid4().hex)
        system.create_dir(self.work, recursive=True)

    def write(self, rows: Iterator) -> Written:
        system = file_system(self.path)[0]
        folder = posixpath.join(self.work, uuid.uuid4().hex)
        system.create_dir(folder, recursive=True)
        seen: set[str] = set()
        made: set[str] = set()
        for row in rows:
            name = str(row[self.place]).replace("\\", "/").rstrip("/").rsplit("/", 1)[-1] + self.suffix
            if name in ("", ".", "..", "_temporary") or name in seen:
                raise ValueError(f"no name of its own for {row[self.place]!r}")
            seen.add(name)
            data = row[self.value]
            own = folder
            if self.folders:
                own = posixpath.join(folder, _folder_name(zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.folders))
                if own not in made:
                    system.create_dir(own)
                    made.add(own)
            with system.open_output_stream(posixpath.join(own, name)) as target:
                target.write(data.encode("utf-8", "surrogateescape") if isinstance(data, str) else bytes(data or b""))
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, _ = file_system(self.path)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(root)):
                if info.base_name != "_temporary":
                    (system.delete_dir if info.type == pafs.FileType.Directory else system.delete_file)(info.path)
        try:
            if self.folders:
                self._place_folders(system, root, [m.folder for m in messages if m])
                return
            taken = {i.base_name for i in system.get_file_info(pafs.FileSelector(root))}
            moves = []
            for message in filter(None, messages):
                for info in system.get_file_info(pafs.FileSelector(message.folder)):
                    if info.base_name in taken:
                        raise ValueError(f"two documents are called {info.base_name!r}")
                    taken.add(info.base_name)
                    moves.append((info.path, posixpath.join(root, info.base_name)))
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda m: system.move(*m), moves))
        finally:
            self._clean(system)

    def _place_folders(self, system: pafs.FileSystem, root: str, written: list[str]) -> None:
        """Move folders that one task alone wrote as they are, and the files of others; names are compared a folder at a time."""
        holders: dict[str, list[str]] = {}
        for folder in written:
            for info in system.get_file_info(pafs.FileSelector(folder)):
                holders.setdefault(info.base_name, []).append(info.path)
        there = {i.base_name for i in system.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory}
        for name, paths in holders.items():
            places = paths + [posixpath.join(root, name)] * (name in there)
            seen: set[str] = set()
            for info in (i for place in places for i in _files_in(system, place, False)) if len(places) > 1 else ():
                if info.base_name in seen:
                    raise ValueError(f"two documents are called {info.base_name!r}")
                seen.add(info.base_name)
        whole = system.type_name in ("local", "hdfs")  # others move files only
        with ThreadPoolExecutor(16) as pool:
            for name, paths in holders.items():
                target = posixpath.join(root, name)
                if whole and name not in there:
                    system.move(paths[0], target)
                    paths = paths[1:]
                system.create_dir(target, recursive=True)
                moves = [(i.path, posixpath.join(target, i.base_name)) for path in paths for i in _files_in(system, path, False)]
                list(pool.map(lambda m: system.move(*m), moves))

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(file_system(self.path)[0])

    def _clean(self, system: pafs.FileSystem) -> None:
        system.delete_dir(self.work)
        above = posixpath.dirname(self.work)
        if not system.get_file_info(pafs.FileSelector(above)):
            system.delete_dir(above)


class PdfSource(D.DataSource):
    """Tables of the files under a path, and a sink for files."""

    @classmethod
    def name(cls) -> str:
        return "pagequarry"

    def schema(self) -> str:
        return f"doc_id string, {SCHEMAS[self.options.get('table', 'documents')]}"

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, schema, overwrite)
