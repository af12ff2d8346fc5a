"""Versioned tables under concurrent writers: stage, then publish once.

A table is a folder.  Writers put data files into a folder of their own
(``data-<id>``), which nobody reads yet, and then publish a *manifest*
``_versions/<number>.json`` that names the data folders of that version.  A
manifest appears whole or not at all, and only one writer can publish a number:

- ``create_if_absent``: the first manifest is the table; a writer that comes
  second drops its files and reads the winner's;
- ``publish_next``: a new version, made again on top of the latest one if
  another writer was faster.

A writer that dies leaves files that no manifest names: the table is as it was
before, and ``remove_orphans`` clears the files away.  Readers open the files
that one manifest names, so a writer never changes what they read.

Publishing needs a folder whose store can rename without overwriting (HDFS and
the like) or, on a local path, link a file.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from typing import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

VERSIONS = "_versions"


class Folder:
    """The few file operations the protocol needs, on any Hadoop path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        at = self._at(sub)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def age_ms(self, name: str) -> int:
        return int(time.time() * 1000) - self.fs.getFileStatus(self._at(name)).getModificationTime()

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def publish(self, source: str, target: str) -> bool:
        """Give the whole file ``source`` the name ``target``; False if that exists."""
        real = self.fs.resolvePath(self._at(source))
        where = urlparse(real.toString())
        if where.scheme in ("", "file"):
            # a local rename would replace the target: a hard link does not
            folder = os.path.dirname(os.path.dirname(where.path))
            try:
                os.link(where.path, os.path.join(folder, target))
                return True
            except FileExistsError:
                return False
            finally:
                self.delete(source)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            files.rename(self._at(source), self._at(target), options)
            return True
        except Exception as e:  # py4j wraps the Java exception
            if "FileAlreadyExists" not in str(e):
                raise
            self.delete(source)
            return False


def _manifest(number: int) -> str:
    return f"{VERSIONS}/{number:08d}.json"


def latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and manifest of the newest version; ``(0, None)`` without one."""
    folder = Folder(spark, path)
    numbers = sorted(int(n[:-5]) for n in folder.names(VERSIONS) if n.endswith(".json"))
    if not numbers:
        return 0, None
    return numbers[-1], json.loads(folder.read(_manifest(numbers[-1])))


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> bool:
    folder = Folder(spark, path)
    staged = f"{VERSIONS}/.{uuid.uuid4().hex}"
    folder.write(staged, json.dumps(manifest))
    return folder.publish(staged, _manifest(number))


def stage(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write ``df`` into a data folder of its own; its name."""
    name = f"data-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path.rstrip('/')}/{name}")
    return name


def create_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> tuple[str, bool]:
    """``CREATE TABLE IF NOT EXISTS ... AS``: the data folder that counts, and
    whether this call made it.  ``build`` runs only if there is no table yet."""
    _, found = latest(spark, path)
    if found is None:
        name = stage(build(), path)
        if _publish(spark, path, 1, {"folders": [name]}):
            return f"{path.rstrip('/')}/{name}", True
        Folder(spark, path).delete(name)
        _, found = latest(spark, path)
    return f"{path.rstrip('/')}/{found['folders'][0]}", False


def publish_next(spark: SparkSession, path: str, change: Callable[[dict | None], dict]) -> int:
    """Publish ``change(latest manifest)``; if another writer was faster, again
    on top of its version."""
    while True:
        number, found = latest(spark, path)
        if _publish(spark, path, number + 1, change(found)):
            return number + 1


def remove_orphans(spark: SparkSession, path: str, older_than_s: float = 86400.0, versions: int | None = None) -> list[str]:
    """Delete data folders that no manifest (or none of the newest ``versions``)
    names and staged manifests, once they are old enough that no living writer
    or reader can be at work on them; their names."""
    folder = Folder(spark, path)
    numbers = sorted(n for n in folder.names(VERSIONS) if n.endswith(".json"))
    kept = numbers if versions is None else numbers[-versions:]
    named = set()
    for n in kept:
        m = json.loads(folder.read(f"{VERSIONS}/{n}"))
        named |= set(m.get("folders", [])) | set(m.get("parts", {}).values())
    gone = [n for n in folder.names() if n.startswith("data-") and n not in named]
    gone += [f"{VERSIONS}/{n}" for n in folder.names(VERSIONS) if n.startswith(".")]
    gone = [n for n in gone if folder.age_ms(n) >= older_than_s * 1000]
    for n in gone:
        folder.delete(n)
    return gone
