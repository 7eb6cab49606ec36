"""Tables that are there whole or not at all: written aside, read back, then published by one file.

A key's table lies in a folder of its own; an empty file in the folder ``_published`` names key and version. That
file is made last, so a job that fails, or is run again after it failed, leaves what readers see as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Published:
    """Keys to tables below ``root``, on any file system that Spark reads. Keys hold no ``~`` or ``/``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> dict[str, list[str]]:
        """Versions of each key, oldest first."""
        marks = self._path(f"{self.root}/_published")
        found: dict[str, list[str]] = {}
        if self._fs.exists(marks):
            for status in self._fs.listStatus(marks):
                key, _, version = status.getPath().getName().partition("~")
                found.setdefault(key, []).append(version)
        return {k: sorted(v) for k, v in found.items()}

    def keys(self) -> list[str]:
        return sorted(self._versions())

    def path(self, key: str) -> str | None:
        """Where the newest published table of the key is."""
        versions = self._versions().get(key)
        return f"{self.root}/{key}/{versions[-1]}" if versions else None

    def paths(self) -> list[str]:
        """Where the newest published tables of all keys are, found by one listing."""
        return [f"{self.root}/{key}/{versions[-1]}" for key, versions in sorted(self._versions().items())]

    def drop(self, path: str) -> None:
        """Deletes a table of a run's own, beside the published ones."""
        self._fs.delete(self._path(path), True)

    def read(self, key: str) -> DataFrame | None:
        path = self.path(key)
        return None if path is None else self.spark.read.parquet(path)

    def commit(self, key: str, df: DataFrame, *, replace: bool = False) -> DataFrame:
        """The key's table: the one published, or ``df`` written and published now.

        With ``replace`` a newer version takes the place of the older, which stays for those who still read it; the one before that goes.
        """
        if "~" in key or "/" in key:
            raise ValueError(f"not a key: {key}")
        old = self._versions().get(key, [])
        if old and not replace:
            return self.read(key)
        version = f"{(int(old[-1].split('-')[0]) if old else 0) + 1:08d}-{uuid.uuid4().hex}"
        path = f"{self.root}/{key}/{version}"
        try:
            df.write.parquet(path)
            found = self.spark.read.parquet(path)
            if [f.name for f in found.schema] != [f.name for f in df.schema]:
                raise ValueError(f"{path} has other columns than were written")
        except BaseException:
            self._fs.delete(self._path(path), True)
            raise
        if not self._fs.createNewFile(self._path(f"{self.root}/_published/{key}~{version}")):
            raise FileExistsError(f"{key} {version} is published already")
        for past in old[:-1]:
            self._fs.delete(self._path(f"{self.root}/_published/{key}~{past}"), False)
            self._fs.delete(self._path(f"{self.root}/{key}/{past}"), True)
        return found

    def retire(self) -> str:
        """Renames the root to a backup, in place of an older one; the backup's path."""
        backup = f"{self.root}.bak"
        self._fs.delete(self._path(backup), True)
        self._fs.rename(self._path(self.root), self._path(backup))
        return backup
