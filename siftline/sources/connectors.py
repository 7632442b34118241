"""Connectors: sources that are discovered, fetched and resumed, as a Spark data source for batch and stream.

``FolderSource`` walks a folder in any store that pyarrow's file systems open (local, HDFS, S3, GCS). The walk is
distributed: the driver lists directories breadth first until there are enough to deal out, and tasks walk what lies below.
A directory of many files is dealt over several tasks, each of which reads the files whose names hash to it. So no
listing of all files is ever held in one place.

The position of a stream is the largest modification time seen (nanoseconds). A batch holds what was modified after the
position before it and up to its own, so a restart with the same checkpoint reads what came since and nothing twice.
A file is handed over with the content it has when it is read.

Files that can't be read, are too large, or are links that lead out of the root come as rows with an ``error`` and
without content: one bad file never fails the others. Hidden files and folders are left out unless asked for; links to folders are
not followed.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftline.functions import fields
from siftline.sources.readers import KIND_OF

ITEM = "path string, name string, extension string, kind string, bytes long, modified timestamp, cursor long, content binary, error string"
SPREAD, FILES_A_PART, BATCH_BYTES, HEALTH_SCAN = 32, 1_000, 16 << 20, 5_000
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("cursor", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


@dataclass(frozen=True)
class Settings:
    """Options of the source. root: a path or URI. since: position after which to read."""

    root: str
    extensions: tuple[str, ...] = ()
    hidden: bool = False
    max_bytes: int = 200 << 20
    since: int = -1
    content: bool = True
    spread: int = SPREAD

    @classmethod
    def of(cls, options: dict[str, str]) -> Settings:
        root = options.get("root") or options.get("path")
        if not root:
            raise ValueError("the option root names the folder to read")
        some = tuple(e.strip().lower().lstrip(".") for e in options.get("extensions", "").split(",") if e.strip())
        yes = lambda name, usual: options.get(name, usual).lower() == "true"
        return cls(root, some, yes("hidden", "false"), int(options.get("max_bytes", 200 << 20)), int(options.get("since", -1)), yes("content", "true"), int(options.get("spread", SPREAD)))


@dataclass
class Part(InputPartition):
    """A directory to read: with all below it, or those of its own files whose names hash to ``nth`` of ``of``."""

    folder: str
    deep: bool
    nth: int
    of: int
    after: int
    until: int | None

    def __init__(self, folder: str, deep: bool, nth: int = 0, of: int = 1, after: int = -1, until: int | None = None):
        self.folder, self.deep, self.nth, self.of, self.after, self.until = folder, deep, nth, of, after, until


class Walk:
    """Lists what the settings let through."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.store, self.root = fs.FileSystem.from_uri(settings.root) if "://" in settings.root else (fs.LocalFileSystem(), os.path.abspath(settings.root))
        self.local = isinstance(self.store, fs.LocalFileSystem)
        if self.local:
            self.root = os.path.realpath(self.root)

    def check(self) -> None:
        kind = self.store.get_file_info(self.root).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(f"source root does not exist: {self.s.root}")
        if kind != fs.FileType.Directory:
            raise NotADirectoryError(f"source root is not a directory: {self.s.root}")

    def entries(self, folder: str) -> tuple[list[fs.FileInfo], list[str]]:
        """Files and sub-folders of a folder, by name; a folder that can't be listed has none."""
        try:
            found = self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        except OSError:
            return [], []
        found = sorted((f for f in found if self.s.hidden or not f.base_name.startswith(".")), key=lambda f: f.path)
        folders = [f.path for f in found if f.type == fs.FileType.Directory and not (self.local and os.path.islink(f.path))]
        return [f for f in found if f.type == fs.FileType.File and self._wanted(f.base_name)], folders

    def _wanted(self, name: str) -> bool:
        return not self.s.extensions or extension_of(name) in self.s.extensions

    def files(self, folder: str, deep: bool) -> Iterator[fs.FileInfo]:
        todo = [folder]
        while todo:
            files, folders = self.entries(todo.pop())
            yield from files
            todo += reversed(folders) if deep else []

    def escapes(self, path: str) -> bool:
        """Whether a path leads out of the root once its links are followed."""
        return self.local and os.path.commonpath([os.path.realpath(path), self.root]) != self.root

    def resolve(self, path: str) -> str:
        """The place in the store that a relative or absolute path names; PermissionError if it is not under the root."""
        if not path.startswith("/") and ".." in path.split("/"):
            raise PermissionError(f"path escapes the source root: {path}")
        whole = path if path.startswith("/") else f"{self.root}/{path}"
        whole = os.path.realpath(whole) if self.local else os.path.normpath(whole)
        if whole != self.root and not whole.startswith(self.root.rstrip("/") + "/"):
            raise PermissionError(f"path leads out of the source root: {path}")
        return whole

    def parts(self, after: int, until: int | None) -> list[Part]:
        out, open_ = [], [self.root]
        while open_ and len(open_) < self.s.spread:
            below = []
            for folder in open_:
                files, folders = self.entries(folder)
                below += folders
                of = -(-len(files) // FILES_A_PART)
                out += [Part(folder, False, n, of, after, until) for n in range(of)]
            open_ = below
        return out + [Part(folder, True, 0, 1, after, until) for folder in open_]

    def items(self, part: Part) -> Iterator[fs.FileInfo]:
        for f in self.files(part.folder, part.deep):
            if zlib.crc32(f.base_name.encode()) % part.of == part.nth and f.mtime_ns > part.after and (part.until is None or f.mtime_ns <= part.until):
                yield f


def extension_of(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name.lstrip(".") else ""


def item_rows(walk: Walk, files: Iterator[fs.FileInfo]) -> Iterator[pa.RecordBatch]:
    """Items as Arrow batches of BATCH_BYTES of content or so."""
    rows, held = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    for f in files:
        content = error = None
        if walk.escapes(f.path):
            error = "leads out of the source root"
        elif f.size > walk.s.max_bytes:
            error = f"larger than {walk.s.max_bytes} bytes"
        elif walk.s.content:
            try:
                with walk.store.open_input_stream(f.path) as data:
                    content = data.read()
            except OSError as e:
                error = f"can't be read: {e.strerror or type(e).__name__}"
        ending = extension_of(f.base_name)
        rows.append({"path": f.path[len(walk.root) :].lstrip("/"), "name": f.base_name, "extension": ending, "kind": KIND_OF.get(ending, "other"), "bytes": f.size, "modified": f.mtime_ns // 1000, "cursor": f.mtime_ns, "content": content, "error": error})
        held += len(content or b"") + 200
        if held >= BATCH_BYTES:
            yield flush()
            rows, held = [], 0
    if rows:
        yield flush()


class _BatchReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[Part]:
        walk = Walk(self.settings)
        walk.check()
        return walk.parts(self.settings.since, None) or [Part(walk.root, False)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        walk = Walk(self.settings)
        return item_rows(walk, walk.items(part))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"cursor": str(self.settings.since)}

    def latestOffset(self) -> dict:
        walk = Walk(self.settings)
        walk.check()
        return {"cursor": str(max((f.mtime_ns for f in walk.files(walk.root, True)), default=self.settings.since))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return Walk(self.settings).parts(int(start["cursor"]), int(end["cursor"]))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        walk = Walk(self.settings)
        return item_rows(walk, walk.items(part))


class FolderSource(DataSource):
    """``spark.read.format("siftline_folder").option("root", ...)``, and the same with readStream."""

    @classmethod
    def name(cls) -> str:
        return "siftline_folder"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(Settings.of(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(Settings.of(self.options))


@dataclass(frozen=True)
class Health:
    status: str  # healthy, degraded, unreachable
    detail: str
    assets: int = 0


class Connector(Protocol):
    """What every source offers: a probe that never raises, items, their contents, and a position to go on from."""

    source_id: str

    def validate(self) -> Health: ...

    def discover(self) -> DataFrame: ...

    def fetch(self, items: DataFrame) -> DataFrame: ...

    def metadata(self) -> dict[str, Any]: ...

    def checkpoint(self, items: DataFrame) -> int: ...

    def restore(self, cursor: int) -> None: ...


#: Settings whose values are never shown.
SECRET = ("password", "secret", "token", "key", "credential")


@dataclass
class FolderConnector:
    """A folder as a source. options: those of FolderSource but for root and since."""

    spark: SparkSession
    source_id: str
    root: str
    options: dict[str, str] = field(default_factory=dict)
    cursor: int = -1

    def __post_init__(self) -> None:
        self.spark.dataSource.register(FolderSource)

    def _reader(self, **more: str) -> DataFrame:
        return self.spark.read.format(FolderSource.name()).options(**(self.options | {"root": self.root} | more)).load()

    def validate(self) -> Health:
        """Counts HEALTH_SCAN files at most."""
        try:
            walk = Walk(Settings.of(self.options | {"root": self.root}))
            walk.check()
            n = sum(1 for _, _ in zip(range(HEALTH_SCAN), walk.files(walk.root, True)))
        except Exception as e:  # noqa: BLE001  a probe must not raise
            return Health("unreachable", str(e))
        if walk.local and not os.access(walk.root, os.R_OK):
            return Health("degraded", f"root is not readable: {self.root}")
        return Health("healthy", f"{n}{'+' if n >= HEALTH_SCAN else ''} files", n)

    def discover(self) -> DataFrame:
        """Items modified after the position, without their contents."""
        return self._reader(since=str(self.cursor), content="false").withColumn("source_id", F.lit(self.source_id)).drop("content")

    def fetch(self, items: DataFrame) -> DataFrame:
        """The contents of given items, as (path, content, error): each task opens the files of its rows."""
        settings = Settings.of(self.options | {"root": self.root})

        def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            walk = Walk(settings)
            for batch in batches:
                for path in batch.path:
                    content = error = None
                    try:
                        whole = walk.resolve(path)
                        if walk.store.get_file_info(whole).size is not None and walk.store.get_file_info(whole).size > settings.max_bytes:
                            raise OSError(f"larger than {settings.max_bytes} bytes")
                        with walk.store.open_input_stream(whole) as data:
                            content = data.read()
                    except OSError as e:
                        error = str(e)
                    yield pd.DataFrame({"path": [path], "content": [content], "error": [error]})

        return items.select("path").mapInPandas(load, "path string, content binary, error string")

    def metadata(self) -> dict[str, Any]:
        shown = {k: "***" if any(s in k.lower() for s in SECRET) else v for k, v in self.options.items()}
        return {"source_id": self.source_id, "type": "local_folder", "root": self.root, **shown}

    def checkpoint(self, items: DataFrame) -> int:
        """The position after ``items``; it moves on only."""
        self.cursor = max(self.cursor, items.agg(F.max("cursor")).first()[0] or -1)
        return self.cursor

    def restore(self, cursor: int) -> None:
        self.cursor = cursor

    def stream(self) -> DataFrame:
        return self.spark.readStream.format(FolderSource.name()).options(**(self.options | {"root": self.root, "since": str(self.cursor)})).load()


@dataclass
class UploadConnector(FolderConnector):
    """A folder that uploads arrive in: items that break the rules for names, sizes and types come with an error."""

    kinds: tuple[str, ...] = ("txt", "md", "html", "json", "csv", "pdf", "docx", "pptx", "xlsx")
    largest: int = 200 << 20

    def discover(self) -> DataFrame:
        reason = fields.upload_reason(F.col("name"), F.col("bytes"), self.kinds, self.largest)
        refused = F.when(reason != "ok", F.concat(F.lit("upload refused: "), reason))
        return super().discover().withColumn("error", F.coalesce("error", refused)).withColumn("name", fields.safe_name(F.col("name")))


def write_files(rows: DataFrame, root: str, path: Column, content: Column) -> int:
    """A file for each row, written where the rows are; returns how many. A task that runs again writes the same."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for at, data in zip(batch.path, batch.content):
                whole = f"{base}/{at}"
                store.create_dir(os.path.dirname(whole), recursive=True)
                with store.open_output_stream(whole) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"n": [len(batch)]})

    done = rows.select(path.alias("path"), content.alias("content")).mapInPandas(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


Work = Callable[[str, bytes], tuple]


def attempted(items: DataFrame, work: Work, schema: str) -> DataFrame:
    """Runs ``work(path, content)`` on each item: path, cursor, the columns of ``schema`` and error.

    An item that failed to load, or on which ``work`` raises, has an error and nulls; the others go on.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, cursor, content, error in zip(batch.path, batch.cursor, batch.content, batch.error):
                values: tuple = (None,) * len(names)
                if error is None:
                    try:
                        values = work(path, bytes(content))
                    except Exception as e:  # noqa: BLE001  whatever it is, it is this item's failure
                        error = f"{type(e).__name__}: {e}"[:500]
                rows.append((path, cursor, *values, error))
            yield pd.DataFrame(rows, columns=["path", "cursor", *names, "error"])

    return items.select("path", "cursor", "content", "error").mapInPandas(run, f"path string, cursor long, {schema}, error string")
