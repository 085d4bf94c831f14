"""Storage of entities behind one interface, and what their rows look like."""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import lists
from fieldloom.operators import hydrate
from fieldloom.operators.mapping import Binding
from fieldloom.operators.members import empty_entity

#: The folder of a table's manifests.
LOG = "_log"
#: Rows that one task sorts, and of one file.
TASK_ROWS = 1 << 20


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """df of so many rows dealt by the key to tasks of about TASK_ROWS each: they grow in number with the table, not in size. As it is if one task does."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, key) if n > 1 else df


class Schemas:
    """Which entities an object of a class is bound to, in order, and their types."""

    def __init__(self, by_class: dict[str, dict[str, T.StructType]]):
        self.by_class = by_class

    def entities(self, class_name: str) -> dict[str, T.StructType]:
        if class_name not in self.by_class:
            raise LookupError(f"no entities for {class_name}")
        return self.by_class[class_name]

    def create(self, class_name: str) -> list[Column]:
        return [empty_entity(s).alias(n) for n, s in self.entities(class_name).items()]


class EntityOperator:
    """How a field of an entity column is read, written, and changed as a list; replace it to store entities otherwise."""

    def get(self, entity: Column, path: str) -> Column:
        return Binding(["entity"], [entity]).read(path)

    def set(self, entity: Column, path: str, value: Column) -> Column:
        return Binding(["entity"], [entity]).write(path, value)

    def add(self, entity: Column, path: str, element: Column) -> Column:
        return self.set(entity, path, lists.add(self.get(entity, path), element))

    def add_at(self, entity: Column, path: str, i: Column, element: Column) -> Column:
        return self.set(entity, path, lists.add_at(self.get(entity, path), i, element))

    def remove(self, entity: Column, path: str, element: Column) -> Column:
        return self.set(entity, path, lists.remove_first(self.get(entity, path), element))


class Store(ABC):
    """Tables of entities by name."""

    @abstractmethod
    def read(self, name: str) -> DataFrame: ...

    @abstractmethod
    def write(self, name: str, rows: DataFrame) -> None: ...

    def find(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of keys; an error for one that is missing."""
        return hydrate.assert_found(self.read(name), keys, key)

    def save(self, name: str, changed: DataFrame, key: str) -> None:
        self.write(name, hydrate.save(self.read(name), changed, key))

    def save_children(self, name: str, changed: DataFrame, roots: DataFrame, key: str) -> None:
        self.write(name, hydrate.replace_children(self.read(name), changed, roots, key))


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class ParquetStore(Store):
    """Tables as data files and one manifest for each version, in one folder of any store that Spark writes.

    A manifest lists a version's files with the least and greatest key in each. It is put in place by a rename that fails if the name is
    taken, so a version is seen whole or not at all, by every store object on the folder, and the second of two writers that began from
    one version gets Conflict. save() and save_children() rewrite the files that hold a changed key and no others: those
    whose range of keys meets the changed range are looked through, the rest stay as they are. Files that no manifest names
    (a failed or lost write) are never read.
    """

    def __init__(self, spark: SparkSession, folder: str, key_of: dict[str, str] | None = None):
        """key_of: the column that a table's files are ranged by, its first one if it is not given."""
        self.spark, self.folder, self.key_of = spark, folder.rstrip("/"), key_of or {}

    # --- the manifests ---

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def version(self, name: str) -> int:
        """The last version, 0 without any."""
        log = self._path(name, LOG)
        fs = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(log):
            return 0
        names = (x.getPath().getName() for x in fs.listStatus(log))
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, name: str, version: int | None = None) -> dict:
        """{"key", "schema", "files": [{"path", "low", "high", "rows"}]} of a version, the last one if it is not given."""
        version = self.version(name) if version is None else version
        if not version:
            raise LookupError(f"no table {name}")
        return json.loads(self.spark.read.text(f"{self.folder}/{name}/{LOG}/{version:020d}.json", wholetext=True).first()[0])

    def _commit(self, name: str, version: int, made: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        beside, target = self._path(name, LOG, f".{uuid.uuid4().hex}"), self._path(name, LOG, f"{version:020d}.json")
        fs = target.getFileSystem(conf)
        fs.mkdirs(target.getParent())
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(beside), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(beside, False)
            if fs.exists(target):
                raise Conflict(f"version {version} of {name} is there already") from e
            raise

    # --- the data ---

    def _files(self, name: str, rows: DataFrame, key: str) -> list[dict]:
        """Write rows ranged by key; the new files with their ranges (as strings that Spark casts back)."""
        folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        n = -(-rows.count() // TASK_ROWS)
        (rows.repartitionByRange(n, F.col(key)) if n > 1 else rows.repartitionByRange(F.col(key))).sortWithinPartitions(key).write.parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        ranges = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"), F.count("*").alias("rows"))
        return [r.asDict() for r in ranges.collect()]

    def _read(self, made: dict, files: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(made["schema"])
        return self.spark.read.schema(schema).parquet(*(f["path"] for f in files)) if files else self.spark.createDataFrame([], schema)

    def rows(self, name: str, version: int | None = None) -> int:
        return sum(f["rows"] for f in self.manifest(name, version)["files"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        made = self.manifest(name, version)
        return self._read(made, made["files"])

    def write(self, name: str, rows: DataFrame) -> None:
        """A version of these rows alone."""
        before = self.version(name)
        key = self.key_of.get(name, rows.columns[0])
        self._commit(name, before + 1, {"key": key, "schema": rows.schema.jsonValue(), "files": self._files(name, rows, key)})

    def _replace(self, name: str, keys: DataFrame, new: DataFrame, key: str) -> None:
        """A version without the rows of keys and with the new ones; only files that hold one of the keys are written again."""
        before = self.version(name)
        made = self.manifest(name, before)
        kind = T.StructType.fromJson(made["schema"])[made["key"]].dataType
        met = made["files"]
        if key == made["key"] and met:
            low, high = keys.agg(F.min(key), F.max(key)).first()
            ranges = self.spark.createDataFrame([(f["path"], f["low"], f["high"]) for f in met], "path string, low string, high string")
            meets = (F.col("low").cast(kind) <= F.lit(high).cast(kind)) & (F.col("high").cast(kind) >= F.lit(low).cast(kind))
            near = {r.path for r in ranges.where(meets).collect()}
            met = [f for f in met if f["path"] in near]
        found = self._read(made, met)
        held = set()
        gone = keys.select(key).distinct()
        if met:
            n = sum(f["rows"] for f in met)
            there = spread(found.select(F.col("_metadata.file_path").alias("path"), key), n, key).join(spread(gone, n, key), key, "left_semi")
            held = {r.path for r in there.select("path").distinct().collect()}  # as many as there are files
        touched = [f for f in met if f["path"] in held]
        n = sum(f["rows"] for f in touched)
        rest = spread(self._read(made, touched), n, key).join(spread(gone, n, key), key, "left_anti")
        schema = T.StructType.fromJson(made["schema"])
        rows = rest.unionByName(new.select(*(F.col(c.name).cast(c.dataType) for c in schema)))
        kept = [f for f in made["files"] if f["path"] not in held]
        self._commit(name, before + 1, made | {"files": kept + self._files(name, rows, made["key"])})

    def save(self, name: str, changed: DataFrame, key: str) -> None:
        self._replace(name, changed, changed, key)

    def save_children(self, name: str, changed: DataFrame, roots: DataFrame, key: str) -> None:
        self._replace(name, roots, changed, key)
