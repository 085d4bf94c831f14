"""Class files and jars as a Spark data source, with splits, pushed filters and columns that aren't parsed unless asked for.

`spark.read.format("classfiles")` after register(spark). Planning lists folders and reads the central directory of each jar that
is larger than a task's share, or of all if entries are filtered by name; else the task that gets a jar reads its directory.
a task gets a run of class files, or a run of one jar's entries, which it reads as one range of bytes. So a large jar is many
tasks, and no row holds a whole jar. Filters that Spark pushes down: class_name (what stands after a class's name is not
parsed if the name isn't wanted), source_path and entry_name (files and entries are not read at all), corrupt IS NULL. Columns are pruned by the
schema that the caller gives: without insns and lines no code is read.

The driver holds no file's path longer than it takes to put it into a task's share, which is packed at once: folders of a local store are listed
as a stream, in the order of the store, and long lists of paths are files that tasks have written (write_list), which planning reads line by line. So neither the
session's options nor tasks hold paths other than their own.

Paths are local or of a store that pyarrow opens (hdfs, s3, gs); classfile.read goes through Spark's own readers instead. A path that does not
exist is an error, as is a jar without a readable directory; a class that cannot be parsed is a row with `corrupt`. Folders are searched
in depth for class files; files of other names give no rows.
"""

from __future__ import annotations

import io
import json
import os
import pickle
import struct
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNull

from fieldloom.sources import classfile

NAME = "classfiles"
#: Bytes of one task, and the cost of opening a file in bytes.
SPLIT_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
#: Jars that planning opens at a time.
OPENED = 1024
#: Fixed: a local file header of the zip format, and its compression methods.
_LOCAL, _STORED, _DEFLATED = "<4s5H3I2H", 0, 8
#: Columns that filters are pushed for.
_SETS = ("class_name", "source_path", "entry_name")


def store_of(path: str) -> tuple[stores.FileSystem, str, str]:
    """The store of a path, the path in it, and what its files' names begin with as URIs."""
    if "://" in path and not path.startswith("file:"):
        store, inner = stores.FileSystem.from_uri(path)
        return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""
    inner = path.removeprefix("file:")
    return stores.LocalFileSystem(), "/" + inner.lstrip("/") if inner.startswith("/") else inner, "file:"


def create(path: str):
    """A file to write bytes to, as a context; its folder is made."""
    store, inner, _ = store_of(path)
    store.create_dir(inner.rpartition("/")[0])
    return store.open_output_stream(inner)


def write_list(path: str, paths: list[str]) -> None:
    """A file of a list that read() can be given: a line for each path."""
    with create(path) as f:
        for p in paths:
            f.write(json.dumps(p).encode() + b"\n")


def _runs(items: list, size_of, most: int) -> Iterator[list]:
    run, have = [], 0
    for x in items:
        if run and have + size_of(x) > most:
            yield run
            run, have = [], 0
        run.append(x)
        have += size_of(x)
    if run:
        yield run


class Split(InputPartition):
    """Class files (path, size), and runs of entries (name, offset, end, compressed size, method) of jars by their paths; None for a jar that is read whole.

    Packed, as there may be millions of paths, which are much alike.
    """

    def __init__(self, files: list[tuple[str, int]], jars: list[tuple[str, list[tuple] | None]]):
        self.packed = zlib.compress(pickle.dumps((files, jars)))

    @property
    def files(self) -> list[tuple[str, int]]:
        return pickle.loads(zlib.decompress(self.packed))[0]

    @property
    def jars(self) -> list[tuple[str, list[tuple] | None]]:
        return pickle.loads(zlib.decompress(self.packed))[1]


class _Shares:
    """Items dealt to splits in their order; a split is made when the next item is too much for it."""

    def __init__(self, split, most: int):
        self.split, self.most, self.made, self.run, self.have = split, most, [], [], 0

    def add(self, item: tuple, size: int) -> None:
        if self.run and self.have + size > self.most:
            self.end()
        self.run.append(item)
        self.have += size

    def end(self) -> list[Split]:
        if self.run:
            self.made.append(self.split(self.run))
        self.run, self.have = [], 0
        return self.made


class ClassFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return classfile.SCHEMA

    def reader(self, schema: T.StructType) -> ClassFileReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        self.planned = True
        return ClassFileReader(schema.names, paths, int(self.options.get("splitBytes", SPLIT_BYTES)), self.options.get("listed"))

    def __getstate__(self) -> dict:
        """Tasks get this object, too, and no more than its name is asked for there: the paths stay here."""
        return self.__dict__ | ({"options": {}} if "planned" in self.__dict__ else {})


class ClassFileReader(DataSourceReader):
    def __init__(self, columns: list[str], paths: list[str], split_bytes: int, listed: str | None = None):
        self.columns, self.paths, self.split_bytes, self.listed = columns, paths, split_bytes, listed
        self.wanted: dict[str, set[str]] = {}
        self.readable_only = False

    def __getstate__(self) -> dict:
        """What tasks get: planning alone needs the paths, of which there may be millions."""
        return self.__dict__ | {"paths": []}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNull)) else None
            if column in _SETS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif column == "corrupt" and isinstance(f, IsNull):
                self.readable_only = True
            else:
                yield f

    def _fits(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def _paths(self) -> Iterator[str]:
        yield from self.paths
        if self.listed is not None:
            store, inner, _ = store_of(self.listed)
            for part in sorted(x.path for x in store.get_file_info(stores.FileSelector(inner)) if x.is_file):
                with store.open_input_stream(part) as f, io.TextIOWrapper(f, "utf-8", newline="\n") as lines:
                    yield from map(json.loads, lines)

    def _files(self) -> Iterator[tuple[str, int]]:
        for path in self._paths():
            store, inner, head = store_of(path)
            info = store.get_file_info(inner)
            if info.type == stores.FileType.NotFound:
                raise FileNotFoundError(path)
            if info.type == stores.FileType.Directory:
                if isinstance(store, stores.LocalFileSystem):
                    yield from ((head + p, size) for p, size in _local_classes(inner))
                    continue
                found = store.get_file_info(stores.FileSelector(inner, recursive=True))
                yield from sorted((head + x.path, x.size) for x in found if x.is_file and x.path.endswith(".class"))
            elif inner.endswith((".class", ".jar")):
                yield head + info.path, info.size

    def _entries(self, jar: str) -> list[tuple]:
        store, inner, _ = store_of(jar)
        with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            ends = sorted(x.header_offset for x in z.infolist())[1:] + [z.start_dir]
            return [(x.filename, x.header_offset, end, x.compress_size, x.compress_type) for x, end in zip(sorted(z.infolist(), key=lambda x: x.header_offset), ends, strict=True) if x.filename.endswith(".class")]

    def partitions(self) -> list[Split]:
        # A filter by entry is worth a look into every jar here: it leaves out those without one.
        most = self.split_bytes if "entry_name" not in self.wanted else -1
        # Small jars share a task.
        plain, jars = _Shares(lambda run: Split(run, []), self.split_bytes), _Shares(lambda run: Split([], run), self.split_bytes)
        unfiled, large = self._fits("entry_name", ""), []
        with ThreadPoolExecutor(16) as pool:
            for path, size in self._files():
                if not self._fits("source_path", path):
                    continue
                if not path.endswith(".jar"):
                    if unfiled:
                        plain.add((path, size), size + OPEN_BYTES)
                elif size <= most:
                    jars.add((path, None), size + OPEN_BYTES)
                else:
                    large.append(path)
                    if len(large) == OPENED:
                        self._open(large, pool, jars)
                        large = []
            self._open(large, pool, jars)
        return plain.end() + jars.end() or [Split([], [])]

    def _open(self, paths: list[str], pool: ThreadPoolExecutor, jars: _Shares) -> None:
        """Runs of these jars' entries, which are read here."""
        for jar, entries in zip(paths, pool.map(self._entries, paths), strict=True):
            kept = [x for x in entries if self._fits("entry_name", x[0])]
            for run in _runs(kept, lambda x: x[2] - x[1], self.split_bytes):
                jars.add((jar, run), run[-1][2] - run[0][1] + OPEN_BYTES)

    def _bytes(self, split: Split) -> Iterator[tuple[str, str, bytes | None, str | None]]:
        """(path, entry, content or None, what is wrong)."""
        for path, _ in split.files:
            store, inner, _ = store_of(path)
            with store.open_input_file(inner) as f:
                yield path, "", f.read(), None
        for jar, entries in split.jars:
            if entries is None:
                entries = self._entries(jar)
            store, inner, _ = store_of(jar)
            with store.open_input_file(inner) as f:
                for name, content, wrong in self._unzipped(f, entries):
                    yield jar, name, content, wrong

    @staticmethod
    def _unzipped(f, entries: list[tuple]) -> Iterator[tuple[str, bytes | None, str | None]]:
        """(entry, content or None, what is wrong); entries that lie side by side are one read."""
        held, start = b"", 0
        for k, (name, at, end, size, method) in enumerate(entries):
            if not start <= at < end <= start + len(held):
                last = end
                for _, a, e, _, _ in entries[k + 1 :]:
                    if a != last:
                        break
                    last = e
                f.seek(at)
                held, start = f.read(last - at), at
            try:
                head = struct.unpack_from(_LOCAL, held, at - start)
                s = at - start + struct.calcsize(_LOCAL) + head[9] + head[10]
                raw = held[s : s + size]
                if head[0] != b"PK\x03\x04" or method not in (_STORED, _DEFLATED) or head[2] & 1:
                    raise ValueError("an entry that cannot be read")
                yield name, raw if method == _STORED else zlib.decompress(raw, -15), None
            except (struct.error, zlib.error, ValueError) as e:
                yield name, None, f"{type(e).__name__}: {e}"

    def read(self, partition: Split) -> Iterator[tuple]:
        names = self.wanted.get("class_name")
        insns, lines = "insns" in self.columns, "lines" in self.columns
        for path, entry, content, wrong in self._bytes(partition):
            found = {"class_name": None, "super_name": None, "annotations": [], "methods": [], "insns": [], "lines": [], "corrupt": wrong}
            try:
                if content is not None:
                    parsed = classfile.parse(content, names, insns, lines)
                    if parsed is None:
                        continue
                    found |= parsed
            except Exception as e:  # a bad class is reported in its row; the others are kept
                found["corrupt"] = f"{type(e).__name__}: {e}"
            if found["corrupt"] is not None and (names is not None or self.readable_only):
                continue
            row = found | {"class_id": f"{path}!{entry}", "source_path": path, "entry_name": entry}
            yield tuple(row[c] for c in self.columns)


def _local_classes(folder: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the class files in a local folder and below it, as a stream."""
    below = []
    with os.scandir(folder) as found:
        for x in found:
            if x.is_dir():
                below.append(x.path)
            elif x.name.endswith(".class") and x.is_file():
                yield x.path, x.stat().st_size
    for path in sorted(below):
        yield from _local_classes(path)


def opens(path: str) -> bool:
    """Whether pyarrow has the path's store, so that this format can read it."""
    try:
        store, inner, _ = store_of(path)
        store.get_file_info(inner)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def register(spark: SparkSession) -> None:
    """Make the format known to the session; Spark pushes filters to Python sources only where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClassFiles)


def read(spark: SparkSession, *paths: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES, listed: str | None = None) -> DataFrame:
    """The classes of these files, jars and folders, and of those that the lists in the folder `listed` name; with columns, only these are parsed."""
    register(spark)
    whole = T.StructType.fromDDL(classfile.SCHEMA)
    schema = T.StructType([whole[c] for c in columns or whole.names])
    found = spark.read.format(NAME).schema(schema).option("paths", json.dumps(list(paths))).option("splitBytes", split_bytes)
    return (found if listed is None else found.option("listed", listed)).load()


def find(spark: SparkSession, paths: list[str], *class_names: str, columns: list[str] | None = None, listed: str | None = None) -> DataFrame:
    """The classes of these names, dotted or internal, by a filter that reaches the scan."""
    return classfile.by_name(read(spark, *paths, columns=columns, listed=listed), *class_names)
