"""Versions of a folder of tables.

Data files are written under new names. One small file per version, moved into place last, names what belongs to it, so that a
reader sees a version whole or not at all, and goes on with the one it opened while a later one is made.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

POINTERS = "versions"


class VersionConflict(RuntimeError):
    """Another writer has published the version in the meantime."""


@dataclass(frozen=True)
class VersionedFolder:
    """The numbered versions in ``path``, which may be in any file system that Spark reads."""

    spark: SparkSession
    path: str

    def _java(self, name: str):
        return getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, name)

    def _path(self, *names: str):
        return self._java("Path")("/".join([self.path.rstrip("/"), *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Published versions, oldest first."""
        files, folder = self._files(), self._path(POINTERS)
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))

    def read(self, number: int | None = None) -> dict | None:
        """What a version (the latest if not named) consists of; None if there is none."""
        known = self.numbers()
        if number is None and not known:
            return None
        chosen = known[-1] if number is None else number
        if chosen not in known:
            raise FileNotFoundError(f"{self.path} has no version {chosen}")
        stream = self._files().open(self._path(POINTERS, f"{chosen:09d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, state: dict) -> None:
        """Make ``state`` version ``number``, in one rename. A version that exists is never replaced."""
        files = self._files()
        draft, pointer = self._path(POINTERS, f".{uuid.uuid4().hex}"), self._path(POINTERS, f"{number:09d}.json")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = self._java("FileContext").getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(self._java("Options$Rename"), 0)
        try:
            context.rename(draft, pointer, no_options)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise VersionConflict(f"{self.path} already has version {number}") from None
            raise

    def delete(self, *names: str) -> None:
        """Delete a file or folder within the folder."""
        self._files().delete(self._path(*names), True)

    def names(self, *names: str) -> list[str]:
        """What a folder within the folder holds."""
        files, folder = self._files(), self._path(*names)
        return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []
