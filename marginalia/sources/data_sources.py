"""Formats for ``spark.read``, ``spark.readStream`` and ``df.write``: layouts, archives and manifests.

    data_sources.register(spark)
    spark.read.format("layouts").load(folder)                          # ALTO and PAGE, a row a region
    spark.readStream.format("archives").option("glob", "*.zip").load(folder)
    regions.write.format("layouts").option("kind", "page").mode("overwrite").save(folder)

Files are listed once, sorted, and dealt into partitions of about ``partition_bytes``; a
task opens its files one at a time. The offset of a stream is the change time and path of
the last file taken in, so each file is read once, and a batch that is run again reads the
same files. Paths are those of pyarrow's file systems (local, HDFS, object stores), which
executors reach as the driver does.

Writing takes layout rows (options ``kind``: alto or page, ``version`` and ``unit`` of ALTO, ``namespace`` of PAGE) with a ``doc_id``, a document's rows in one partition (see
``by_document``), and puts each document into a file of its name. A task writes beside the
folder, and the files are moved there when all tasks are done, so a failed or repeated task
leaves nothing. ``overwrite`` empties the folder of files of that ending first.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import LAYOUT_ROW
from .ingest import archive_entries
from .layout_writer import alto_text, page_text
from .xml_layout import parse

PARTITION_BYTES = 32_000_000
FILES_PER_BATCH = 1_000


@dataclass
class Files(InputPartition):
    """Paths that a task reads."""

    paths: tuple[str, ...]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str) -> list[tuple[int, str, int]]:
    """(change time, path, size) of the files whose name fits, sorted."""
    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    files = [x for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, glob) and not x.base_name.startswith(("_", "."))]
    return sorted((x.mtime_ns or 0, x.path, x.size or 0) for x in files)


def dealt(files: Sequence[tuple[int, str, int]], most: int) -> list[Files]:
    """The files as partitions of about so many bytes; a larger file is one of its own."""
    out: list[list[str]] = []
    room = 0
    for _, path, size in files:
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(path)
        room -= size
    return [Files(tuple(paths)) for paths in out]


class FileSource(DataSource):
    """A format of whole files; ``rows`` turns one into rows."""

    glob = "*"
    columns: T.StructType

    def schema(self) -> T.StructType:
        return self.columns

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError(self.name())

    def setting(self, name: str, default):
        return type(default)(self.options.get(name, default))

    def listed(self) -> list[tuple[int, str, int]]:
        return listed(self.options["path"], self.setting("glob", self.glob))

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _system(self.options["path"])
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                yield from self.rows(path, file.read())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: FileSource) -> None:
        self.source = source

    def partitions(self) -> list[Files]:
        # a table without files is one empty partition
        return dealt(self.source.listed(), self.source.setting("partition_bytes", PARTITION_BYTES)) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.source.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: FileSource) -> None:
        self.source = source
        self.last: tuple[int, str] | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The last of the next ``files_per_batch`` files after those already taken in."""
        after = self.last or (-1, "")
        new = [x for x in self.source.listed() if x[:2] > after][: self.source.setting("files_per_batch", FILES_PER_BATCH)]
        self.last = new[-1][:2] if new else after
        return {"time": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = ((x["time"], x["path"]) for x in (start, end))
        # after a restart the offsets come from the checkpoint
        self.last = max(self.last or last, last)
        files = [x for x in self.source.listed() if first < x[:2] <= last]
        return dealt(files, self.source.setting("partition_bytes", PARTITION_BYTES)) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.source.read(partition)

    def commit(self, end: dict) -> None:
        pass


def _name(path: str, ending: str = "") -> str:
    name = path.rpartition("/")[2]
    return name.removesuffix(ending) if ending else name.partition(".")[0]


class Layouts(FileSource):
    """ALTO and PAGE files: ``path``, ``doc_id`` and a row a region; files that don't parse are one row without a region."""

    glob = "*.xml"
    columns = T.StructType([T.StructField("path", T.StringType()), T.StructField("doc_id", T.StringType()), *LAYOUT_ROW.fields])

    @classmethod
    def name(cls) -> str:
        return "layouts"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        found = parse(data)
        for row in found if found is not None else ({},):
            yield (path, _name(path, ".xml"), *(_as_row(f.dataType, row.get(f.name)) for f in LAYOUT_ROW.fields))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        settings = {k: self.options[k] for k in ("version", "unit", "namespace") if k in self.options}
        return LayoutWriter(self.options["path"], self.options.get("kind", "alto"), settings, schema, overwrite)


def _as_row(kind: T.DataType, value):
    """Dictionaries as tuples, which is how a data source hands over structs."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_as_row(f.dataType, value[f.name]) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_as_row(kind.elementType, x) for x in value]
    return value


class Archives(FileSource):
    """Zip files: ``path`` and an entry's ``name`` and ``content``, or ``problem`` of one that is not sound."""

    glob = "*.zip"
    columns = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("problem", T.StringType())])

    @classmethod
    def name(cls) -> str:
        return "archives"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        found = archive_entries(data)
        if isinstance(found, str):
            yield path, None, None, found
        else:
            yield from ((path, name, content, None) for name, content in found)


class Manifests(FileSource):
    """Manifests of digitised books, versions 2 and 3: ``path``, ``pos``, ``label`` and ``image`` of each page that has one."""

    glob = "*.json"
    columns = T.StructType([T.StructField("path", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("image", T.StringType())])

    @classmethod
    def name(cls) -> str:
        return "manifests"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        try:
            book = json.loads(data)
        except ValueError:
            return
        pages = _at(book, "items")
        for pos, page in enumerate(pages if isinstance(pages, list) else _at(book, "sequences", 0, "canvases") or ()):
            image = _at(page, "items", 0, "items", 0, "body", "id") or _at(page, "images", 0, "resource", "@id")
            label = _at(page, "label")
            if isinstance(label, dict):
                label = next((_at(label, k, 0) for k in ("none", "fr", "en") if _at(label, k, 0)), None)
            if image:
                yield path, pos, label and str(label), str(image)


def _at(value, *path):
    """What is at the end of keys and places, None if it is not there."""
    for step in path:
        try:
            value = value[step]
        except (KeyError, IndexError, TypeError):
            return None
    return value


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class LayoutWriter(DataSourceWriter):
    """Documents as ALTO or PAGE files, one each."""

    def __init__(self, path: str, kind: str, settings: dict[str, str], schema: T.StructType, overwrite: bool) -> None:
        if kind not in ("alto", "page"):
            raise ValueError(f"layouts are written as alto or page, not {kind!r}")
        if missing := {"doc_id", *(f.name for f in LAYOUT_ROW.fields)} - set(schema.names):
            raise ValueError(f"columns missing: {sorted(missing)}")
        self.path, self.kind, self.settings, self.overwrite = path, kind, settings, overwrite
        self.beside = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.path)
        system.create_dir(f"{root}/{self.beside}", recursive=True)
        names, held, last = [], [], None
        for row in rows:
            if held and row["doc_id"] != last:
                names.append(self._file(system, root, last, held))
                held = []
            last = row["doc_id"]
            held.append(row.asDict(recursive=True))
        if held:
            names.append(self._file(system, root, last, held))
        return Written(tuple(names))

    def _file(self, system: fs.FileSystem, root: str, doc: str, rows: list[dict]) -> str:
        text = (alto_text if self.kind == "alto" else page_text)(rows, **self.settings)
        # under a name of its own, as a task may be run twice at a time
        name = f"{self.beside}/{uuid.uuid4().hex}/{doc}.xml"
        system.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
        with system.open_output_stream(f"{root}/{name}") as file:
            file.write(text.encode())
        return name

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        names = [name for m in messages if m for name in m.names]
        if len({n.rpartition("/")[2] for n in names}) < len(names):
            self.abort(messages)
            raise ValueError("a document's rows are in more than one place; see by_document")
        if self.overwrite:
            for _, path, _ in listed(self.path, "*.xml"):
                if self.beside not in path:
                    system.delete_file(path)
        for name in names:
            system.move(f"{root}/{name}", f"{root}/{name.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.beside}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.beside}")


def by_document(regions: DataFrame) -> DataFrame:
    """The rows of each document together and in order, as the writer takes them."""
    return regions.repartition("doc_id").sortWithinPartitions("doc_id", "dfs_pos")


def register(spark: SparkSession) -> None:
    for source in (Layouts, Archives, Manifests):
        spark.dataSource.register(source)
