"""A written extract that outlives the executors, with the time and the source files it was made from."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, types as T

from shelfwise.sources.versions import VersionedFolder

TTL_SECONDS = 300.0
ATTEMPTS = 3


class SourcesChanging(RuntimeError):
    """The source files changed during every attempt to read them."""


def source_state(sources: Iterable[DataFrame]) -> dict:
    """Number of files behind ``sources``, and a digest of their names, lengths and times of change."""
    digest, count = hashlib.sha256(), 0
    for frame in sources:
        spark = frame.sparkSession
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        for name in sorted(frame.inputFiles()):
            path = hadoop.Path(spark.sparkContext._jvm.java.net.URI(name))
            files = path.getFileSystem(conf)
            status = files.getFileStatus(path) if files.exists(path) else None
            digest.update(json.dumps([name, status and status.getLen(), status and status.getModificationTime()]).encode())
            count += 1
    return {"files": count, "digest": digest.hexdigest()}


class ExtractSnapshot:
    """An extract kept as a version in ``folder``, for ``ttl_seconds`` or until its source files change.

    ``read_sources`` opens the source frames anew, so that it sees the files of the moment; ``build`` makes the extract from
    them. A version is published only if the files were the same before and after it was written, so that no extract mixes two states of the
    source, whatever becomes of executors. Readers of an older version keep it; ``sweep`` deletes all but the last versions.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        read_sources: Callable[[], list[DataFrame]],
        build: Callable[..., DataFrame],
        ttl_seconds: float = TTL_SECONDS,
        clock: Callable[[], float] = time.time,
    ) -> None:
        self._spark, self._read_sources, self._build, self._ttl, self._clock = spark, read_sources, build, ttl_seconds, clock
        self._versions = VersionedFolder(spark, folder)

    def state(self) -> dict | None:
        """Number, time and source of the latest version."""
        return self._versions.read()

    def is_stale(self) -> bool:
        state = self.state()
        if state is None or not 0 <= self._clock() - state["time"] < self._ttl:
            return True
        return state["source"] != source_state(self._read_sources())

    def get(self) -> DataFrame:
        """The extract, made anew where it is stale."""
        return self.refresh() if self.is_stale() else self._open(self.state())

    def refresh(self) -> DataFrame:
        """Make the extract anew."""
        for _ in range(ATTEMPTS):
            sources = self._read_sources()
            before, now = source_state(sources), self._clock()
            name = uuid.uuid4().hex
            extract = self._build(*sources)
            extract.write.parquet(self._data(name))
            if source_state(self._read_sources()) != before:
                self._versions.delete("data", name)
                continue
            number = max(self._versions.numbers(), default=0) + 1
            state = {"number": number, "time": now, "source": before, "data": name, "schema": extract.schema.jsonValue()}
            self._versions.publish(number, state)
            return self._open(state)
        raise SourcesChanging(f"the source files changed {ATTEMPTS} times while they were read")

    def sweep(self, keep: int = 2) -> None:
        """Delete all versions but the last ``keep`` with their data."""
        for number in self._versions.numbers()[:-keep]:
            data = self._versions.read(number)["data"]
            self._versions.delete("versions", f"{number:09d}.json")
            self._versions.delete("data", data)

    def _data(self, name: str) -> str:
        return f"{self._versions.path.rstrip('/')}/data/{name}"

    def _open(self, state: dict) -> DataFrame:
        return self._spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(self._data(state["data"]))
