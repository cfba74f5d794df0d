"""Tables whose writes are published whole: data go to a fresh folder, and one rename of a manifest makes them the table.

A table is a folder with `data/<id>` folders of Parquet files and manifests `_manifests/<number>.json`, each of which lists the data folders that
make up the table and the ids of the batches that were appended. The manifest with the highest number counts. A writer that dies before its rename leaves the
last version readable and a folder that nothing lists; one that finds its number taken reads the new manifest and tries again, if it
appends, or fails, if it overwrites. A batch id that is listed isn't appended again, so a rerun does only what is pending.
Manifests stay until vacuum(); what nothing lists goes with it. Rename without overwriting is what HDFS and local file systems do; a store without it
needs a committer of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries of a writer whose number was taken.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer published first."""


class _Store:
    """The folder of one table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        place = self.at(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("_manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> tuple[int, dict]:
        """The number and content of a manifest, by default the last; 0 and an empty one before the first."""
        own = self.numbers()
        if number is None and not own:
            return 0, {"folders": [], "batches": []}
        number = own[-1] if number is None else number
        stream = self.fs.open(self.at(f"_manifests/{number:08d}.json"))
        try:
            return number, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        """Makes content the manifest of that number; Conflict if there is one."""
        draft, final = self.at(f"_manifests/.{uuid.uuid4().hex}"), self.at(f"_manifests/{number:08d}.json")
        self.fs.mkdirs(self.at("_manifests"))
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.path} is there already")


def _write(df: DataFrame, store: _Store) -> str:
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{store.path}/{folder}")
    return folder


def overwrite(df: DataFrame, path: str) -> int:
    """Makes df the table; its version number. Readers see the old rows until all new ones are written."""
    store = _Store(df.sparkSession, path)
    number, _ = store.manifest()
    folder = _write(df, store)
    store.publish(number + 1, {"folders": [folder], "batches": []})
    return number + 1


def append(df: DataFrame, path: str, batch: str) -> bool:
    """Adds df as a batch of that id; False, without work, if the table has it."""
    store = _Store(df.sparkSession, path)
    if batch in store.manifest()[1]["batches"]:
        return False
    folder = _write(df, store)
    for _ in range(TRIES):
        number, old = store.manifest()
        if batch in old["batches"]:
            store.fs.delete(store.at(folder), True)
            return False
        try:
            store.publish(number + 1, {"folders": [*old["folders"], folder], "batches": [*old["batches"], batch]})
            return True
        except Conflict:
            continue
    raise Conflict(f"{TRIES} other writers published to {path} first")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The table, or that version of it; None before the first."""
    store = _Store(spark, path)
    _, own = store.manifest(number)
    if not own["folders"]:
        return None
    return spark.read.parquet(*[f"{store.path}/{f}" for f in own["folders"]])


def batches(spark: SparkSession, path: str) -> list[str]:
    return _Store(spark, path).manifest()[1]["batches"]


def resume(inputs: DataFrame, stage: Callable[[DataFrame], DataFrame], path: str, key: str, parts: int = 8, run: str = "run") -> int:
    """Runs stage over the rows of inputs in `parts` batches by a hash of the key, each published when it is done; how many batches were left to do.

    A killed run keeps the batches that it published, and the next one with the same name of a run does the others.
    """
    done = set(batches(inputs.sparkSession, path))
    todo = [k for k in range(parts) if f"{run}/{parts}/{k}" not in done]
    for k in todo:
        append(stage(inputs.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)) == k)), path, f"{run}/{parts}/{k}")
    return len(todo)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all manifests but the last `keep`, and folders that none of these lists; how many folders. No writer may be at work."""
    store = _Store(spark, path)
    numbers = store.numbers()
    listed = {f for n in numbers[-keep:] for f in store.manifest(n)[1]["folders"]}
    for n in numbers[:-keep]:
        store.fs.delete(store.at(f"_manifests/{n:08d}.json"), False)
    gone = [f for f in store.names("data") if f"data/{f}" not in listed]
    for f in gone:
        store.fs.delete(store.at(f"data/{f}"), True)
    return len(gone)
