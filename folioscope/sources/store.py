"""Built tables that are kept: made once for a state of their inputs, loaded after that.

A table's version is a digest of its name, its parameters and of every input file (path, length, time of change), so a new,
changed or deleted file, or another parameter, makes a new version and nothing else does. Rows are written to a folder of
their own first; the small pointer that names it is written last and at once, so a run that dies leaves no half version, and of
two runs that build the same version one is used. A new version removes the ones of the same inputs before it, and what dead
runs left a day ago. Everything goes through Hadoop's file systems, so a store may lie wherever Spark writes.

Readers of a version must be done before its inputs change and it is asked for again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from folioscope.session import ensure_checkpoint_dir

#: Part of every version: raise it when the meaning of a stored table changes.
LAYOUT = 2
ORPHAN_MS = 24 * 3600 * 1000


class Files:
    """The few file operations that the store needs, on the file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.system = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def below(self, path: str):
        """(path, length, time of change) of every file under ``path``, which may be a file itself."""
        found = self.system.listFiles(self.path(path), True)
        while found.hasNext():
            status = found.next()
            yield status.getPath().toString(), status.getLen(), status.getModificationTime()

    def entries(self, path: str):
        """(path, time of change, whether it is a folder) of what lies in a folder."""
        if not self.system.exists(self.path(path)):
            return []
        return [(s.getPath().toString(), s.getModificationTime(), s.isDirectory()) for s in self.system.listStatus(self.path(path))]

    def text(self, path: str) -> str | None:
        if not self.system.exists(self.path(path)):
            return None
        stream = self.system.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.system.create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        self.system.delete(self.path(path), True)


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:32]


class Store:
    """Tables derived from ``inputs`` (files or folders) with ``parameters``, below ``root`` (default: the shared folder)."""

    def __init__(self, spark: SparkSession, inputs: Sequence[str], root: str | None = None, **parameters):
        self.spark = spark
        self.root = root or f"{ensure_checkpoint_dir(spark)}/store"
        files = hashlib.sha256()
        for path in sorted(inputs):
            for entry in sorted(Files(spark, path).below(path)):
                files.update(repr(entry).encode())
        self.origin = digest(sorted(inputs))
        self.state = digest(LAYOUT, files.hexdigest(), parameters)
        self.built: list[str] = []

    def keep(self, build: Callable[[], DataFrame], name: str, by: str | None = None) -> DataFrame:
        """The stored table ``name``, made by ``build()`` if this version of it does not exist; in folders by column ``by``."""
        home = f"{self.root}/{name}/{self.origin}"
        files, pointer = Files(self.spark, self.root), f"{home}/{self.state}.json"
        told = files.text(pointer)
        if told is None:
            df, data = build(), f"{home}/{uuid.uuid4().hex}"
            writer = df.write.option("compression", "zstd")  # written once, kept long
            if by is None:
                writer.parquet(data)
            else:
                writer.partitionBy(by).parquet(data)  # every task sorts its own rows into the folders, nothing is shuffled
            files.write(pointer, json.dumps({"data": data, "schema": df.schema.json()}))
            self.built.append(name)
            told = files.text(pointer)
            self._clear(files, home, pointer, json.loads(told)["data"])
        version = json.loads(told)
        schema = T.StructType.fromJson(json.loads(version["schema"]))
        return self.spark.read.schema(schema).parquet(version["data"]).select(*schema.names)

    def _clear(self, files: Files, home: str, pointer: str, data: str) -> None:
        """Drop earlier versions, and folders that no pointer names once they are a day old."""
        last = lambda path: path.rstrip("/").rsplit("/", 1)[-1]
        entries = files.entries(home)
        own, former = {last(pointer), last(data)}, set()
        for path, _, folder in entries:
            if not folder and last(path) not in own and path.endswith(".json"):
                former.add(last(json.loads(files.text(path))["data"]))
                files.remove(path)
        now = time.time() * 1000
        for path, changed, folder in entries:
            if folder and last(path) not in own and (last(path) in former or now - changed > ORPHAN_MS):
                files.remove(path)
