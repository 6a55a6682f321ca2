"""A JSON file of records by id, on any file system that Spark reaches."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from copy import deepcopy

from pyspark.sql import SparkSession

from lodestone.errors import LodestoneError, NotFound


class JsonStore:
    """Reads its newest version when first used and writes the next after each change (``autosave``) or on ``stop``.

    A version is a file of its own, renamed to its name when whole, and the one before stays:
    whenever a writer is cut off, the newest whole version is there to read.
    """

    def __init__(self, spark: SparkSession, path: str, autosave: bool = True) -> None:
        self.spark, self.path, self.autosave = spark, path, autosave
        self._records: dict | None = None

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self) -> tuple[object, list[tuple[int, str]]]:
        """The file system, and the number and path of each whole version, the newest last."""
        target = self._at(self.path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(f.getPath()) for f in files.globStatus(self._at(f"{self.path}.*")) or ()]
        return files, sorted((int(f.rsplit(".", 1)[1]), f) for f in found if f.rsplit(".", 1)[1].isdigit())

    @property
    def records(self) -> dict:
        if self._records is None:
            _, versions = self._versions()
            self._records = {}
            if versions:
                text = "\n".join(r[0] for r in self.spark.read.text(versions[-1][1]).collect())
                self._records = json.loads(text) if text else {}
        return self._records

    def all(self) -> Iterator[tuple[str, dict]]:
        return iter(deepcopy(list(self.records.items())))

    def one(self, key: str) -> dict:
        if key not in self.records:
            raise NotFound(f"{key!r} isn't stored")
        return deepcopy(self.records[key])

    def multi(self, keys: Iterable[str]) -> dict[str, dict]:
        return {k: deepcopy(self.records[k]) for k in keys if k in self.records}

    def next_key(self) -> str:
        return str(max((int(k) for k in self.records if k.isdigit()), default=0) + 1)

    def insert(self, record: dict, key: str | None = None) -> str:
        key = self.next_key() if key is None else key
        if key in self.records:
            raise LodestoneError(f"{key!r} is stored")
        self.records[key] = deepcopy(record)
        self._changed()
        return key

    def update(self, key: str, record: dict) -> None:
        self.one(key)
        self.records[key] = deepcopy(record)
        self._changed()

    def delete(self, key: str) -> None:
        if self.records.pop(key, None) is not None:
            self._changed()

    def _changed(self) -> None:
        if self.autosave:
            self.stop()

    def stop(self) -> None:
        """Writes the next version beside the others, then removes all but it and the one before."""
        files, versions = self._versions()
        number = versions[-1][0] + 1 if versions else 1
        beside = self._at(f"{self.path}.{number}.new")
        stream = files.create(beside, True)
        stream.write(bytearray(json.dumps(self.records), "utf-8"))
        stream.close()
        if not files.rename(beside, self._at(f"{self.path}.{number}")):
            raise LodestoneError(f"{self.path} has been written by another")
        for _, old in versions[:-1]:
            files.delete(self._at(old), False)
