"""The registry of indexes: created, listed, loaded and dropped; documents lie as Parquet beside a JSON catalog."""

from __future__ import annotations

import datetime
import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import IndexAlreadyExists, IndexNotFound, InvalidRequest, ValidationError
from lodestone.index import GUID, Index, Inverted
from lodestone.operators import leaves
from lodestone.plans.schema import Schema
from lodestone.sources.store import JsonStore


def work_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is set, a local one for a session without executors of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise InvalidRequest("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lodestone-")


class Engine:
    """Without a folder, indexes last as long as the object."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self._indexes: dict[str, Index] = {}
        self._catalog = JsonStore(spark, f"{self.folder}/indexes.json") if self.folder else None
        for name, record in self._catalog.all() if self._catalog else ():
            self._indexes[name] = self._opened(name, record)

    def _opened(self, name: str, record: Mapping) -> Index:
        schema, created = Schema.parse(record["schema"]), datetime.datetime.fromisoformat(record["createdAt"])
        if not record.get("version"):
            return Index(name, schema, Index.empty(self.spark, name, record["schema"]).stored, record["key"], created)
        path = self._path(record["place"], record["version"])
        text = [f.name for f in schema.fields.values() if f.kind == "text"]
        inverted = {f: Inverted.read(self.spark, f"{path}/text/{leaves.plain(f)}") for f in text}
        return Index(name, schema, self.spark.read.parquet(f"{path}/docs"), record["key"], created, inverted)

    def _path(self, place: str, version: int | None = None) -> str:
        """The folder of an index, named by the engine and not after the index."""
        if not re.fullmatch("[0-9a-f]{32}", place):
            raise ValidationError({"place": "no folder of this engine"})
        return f"{self.folder}/{place}" + ("" if version is None else f"/v{version}")

    def create_index(self, name: str, spec: Mapping, docs: DataFrame | None = None, key: str = GUID) -> Index:
        if not isinstance(name, str) or not 1 <= len(name) <= 255 or not re.fullmatch(r"[^/\\\x00-\x1f]+", name) or name in (".", "..", "indexes.json"):
            raise ValidationError({"name": "1 to 255 characters are needed, without slashes, and no name of a folder or file of the engine"})
        if name in self._indexes:
            raise IndexAlreadyExists(name)
        index = Index.empty(self.spark, name, spec) if docs is None else Index.over(name, spec, docs, key)
        if self._catalog:
            self._catalog.insert({"schema": index.schema.source, "createdAt": index.created_at.isoformat(), "key": index.key, "version": 0, "place": uuid.uuid4().hex}, name)
        self._indexes[name] = index
        return index

    def list_indexes(self) -> DataFrame:
        rows = [(n, i.created_at.replace(tzinfo=None)) for n, i in self._indexes.items()]
        return self.spark.createDataFrame(rows, "name string, created_at timestamp_ntz")

    def get_index(self, name: str) -> Index:
        if name not in self._indexes:
            raise IndexNotFound(name)
        return self._indexes[name]

    def drop_index(self, name: str) -> None:
        self.get_index(name)
        if self._catalog:
            path = self._path(self._catalog.one(name)["place"])
            self._catalog.delete(name)
            self._remove(path)
        del self._indexes[name]

    def _remove(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def save(self, name: str) -> str:
        """Writes the documents, their tokens and the inverted index of each text field as a new version, then points the catalog at it.

        The version before stays for those who read it; older ones go.
        """
        index, record = self.get_index(name), self._catalog.one(name)
        version = record.get("version", 0) + 1
        path = self._path(record["place"], version)
        index.docs.write.mode("overwrite").parquet(f"{path}/docs")
        written = self.spark.read.parquet(f"{path}/docs")
        for field in index.schema.fields.values():
            if field.kind == "text":
                Inverted.of(written, index.key, field.name).write(f"{path}/text/{leaves.plain(field.name)}")
        record = {**record, "version": version}
        self._catalog.update(name, record)
        self._indexes[name] = self._opened(name, record)
        if version > 2:
            self._remove(self._path(record["place"], version - 2))
        return path

    def stop(self) -> None:
        for name in self._indexes if self._catalog else ():
            self.save(name)
