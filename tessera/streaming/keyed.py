"""A table by key that batches of changes update bucket by bucket, while readers keep the version they began with.

Rows lie in hash buckets, each a folder.  A batch reads and writes only the buckets that its keys fall in; the others keep their folders.  A version
is one small file that names the folder of each bucket.  It appears by a rename when all of them are written, so a reader that takes the
newest one never sees half a batch, and as folders are not changed, one that began before goes on as it was.  :meth:`KeyedTable.forget` deletes what no kept
version names.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import last_by


class KeyedTable:
    """The newest row of each key in ``path``; ``order`` tells which of two is newer.  The number of buckets stays as it was at first."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.buckets = buckets

    def _at(self, *parts: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the finished versions, oldest first."""
        at, fs = self._at("versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def manifest(self, version: int) -> dict[str, Any]:
        at, _ = self._at("versions", f"{version:09d}.json")
        return json.loads(self.spark.read.text(at.toString(), wholetext=True).first().value)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, or of the newest; null without any."""
        known = self.versions()
        if not known:
            return None
        held = self.manifest(known[-1] if version is None else version)
        return self._rows(held, list(held["folders"].values()))

    def _rows(self, held: dict[str, Any], folders: list[str]) -> DataFrame:
        read = self.spark.read.schema(held["schema"])
        return read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], held["schema"])

    def apply(self, rows: DataFrame, number: int) -> dict[str, int] | None:
        """Add a batch as version ``number``, in which the newer of the batch's and the stored row of a key stays; returns ``buckets`` and ``bytes`` written.  A version that is there already stays."""
        before = self.versions()
        if number in before:
            return None
        held = self.manifest(max(before)) if before else {"folders": {}, "schema": None, "buckets": self.buckets}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(held["buckets"])).cast("int")
        rows = rows.persist()
        try:
            touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())  # at most all buckets
            old = [f for b in touched if (f := held["folders"].get(str(b)))]
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            stored = self._rows(held, old) if held["schema"] else rows.limit(0)
            name = f"data/{number:09d}"
            merged = last_by(stored.unionByName(rows), [self.key], self.order)
            merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            rows.unpersist()
        written, fs = self._at(name)
        folders = held["folders"] | {str(b): f"{name}/_bucket={b}" for b in touched}
        self._publish(number, {"folders": folders, "schema": kinds, "buckets": held["buckets"]})
        return {"buckets": len(touched), "bytes": fs.getContentSummary(written).getLength()}

    def _publish(self, number: int, held: dict[str, Any]) -> None:
        draft, fs = self._at("versions", f"_{number:09d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        fs.rename(draft, self._at("versions", f"{number:09d}.json")[0])

    def forget(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and the folders that only they name."""
        known = self.versions()
        kept = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            for f in self.manifest(v)["folders"].values():
                if f not in kept:
                    at, fs = self._at(f)
                    fs.delete(at, True)
            at, fs = self._at("versions", f"{v:09d}.json")
            fs.delete(at, True)


class Reloads:
    """Requests to rebuild something slow: those that wait while one runs are answered together by the next."""

    def __init__(self, rebuild: Callable[[], Any]):
        self.rebuild, self.rebuilt = rebuild, 0
        self._lock, self._waiting, self._running = threading.Lock(), [], False

    def request(self) -> Future:
        """A future of the result of a rebuild that begins after this call."""
        future: Future = Future()
        with self._lock:
            self._waiting.append(future)
            if not self._running:
                self._running = True
                threading.Thread(target=self._run, daemon=True).start()
        return future

    def _run(self) -> None:
        while True:
            with self._lock:
                answered, self._waiting = self._waiting, []
                if not answered:
                    self._running = False
                    return
            try:
                result, error = self.rebuild(), None
                self.rebuilt += 1
            except Exception as e:  # handed on to all who asked
                result, error = None, e
            for future in answered:
                future.set_exception(error) if error else future.set_result(result)
