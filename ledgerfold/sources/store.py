"""A versioned store: immutable Parquet files and one small manifest per version.

A commit writes the batch's files first and its manifest aside, and then claims the
next version number by renaming the manifest, which fails if another writer was first.
So a manifest is whole from the moment it is seen. Readers use the newest one and are
never blocked; nothing that is referred to changes. The file system's rename has to be
exclusive, as HDFS's is; stores of objects need a committer of their own.
"""

from __future__ import annotations

import copy
import json
import os
import tempfile
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ledgerfold.errors import Custom, UriError
from ledgerfold.functions.cells import CELL

#: One write of one cell. ``preds`` names the writes of the same cell that it replaces.
OPS = f"row_id string, col string, counter bigint, actor string, op_id string, cell {CELL}, preds array<string>"
TOMBSTONES = "row_id string"
#: A file's rows, at most, so that what one task has written is read by several.
RECORDS_A_FILE = 1_000_000

EMPTY_MANIFEST: dict[str, Any] = {
    "version": 0,
    "tables": {},
    "fields": {},
    "indexes": {},
    "index_fields": {},
    "kinds": {},
    "bases": {},
    "ops": {},
    "tombstones": {},
}


class Store:
    """Files under ``root`` by way of Hadoop's file systems, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def latest(self) -> dict:
        folder = self._path(f"{self.root}/versions")
        newest = 0
        if self.fs.exists(folder):
            for status in self.fs.listStatus(folder):
                name = status.getPath().getName()
                if name.endswith(".json") and name[:-5].isdigit():
                    newest = max(newest, int(name[:-5]))
        if not newest:
            return copy.deepcopy(EMPTY_MANIFEST)
        stream = self.fs.open(self._path(f"{self.root}/versions/{newest:012d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict, based_on: int) -> None:
        """Makes ``manifest`` the version after ``based_on``; a transaction conflict if that is taken."""
        manifest["version"] = based_on + 1
        path = self._path(f"{self.root}/versions/{based_on + 1:012d}.json")
        aside = self._path(f"{self.root}/versions/_{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        try:
            self._rename(aside, path)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Custom("Transaction conflict") from e
            raise

    def _rename(self, source, target) -> None:
        """Fails if the target is there."""
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        none = gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        files = hadoop.FileContext.getFileContext(self.fs.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self.fs.makeQualified(source), self.fs.makeQualified(target), none)

    # -- data

    def write(self, df: DataFrame, kind: str) -> str:
        """Writes rows and returns their folder."""
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", RECORDS_A_FILE).parquet(f"{self.root}/{name}")
        return name

    def read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names])

    def size(self, names: list[str]) -> int:
        """Bytes of files in folders that write() returned."""
        return sum(self.fs.getContentSummary(self._path(f"{self.root}/{n}")).getLength() for n in names)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)

    def destroy(self) -> None:
        self.fs.delete(self._path(self.root), True)


def shared_folder(spark: SparkSession) -> str:
    """Where tables of a session may lie: the shared checkpoint folder, or, where none is set and the master is local, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return root.rstrip("/") if root else "file://" + os.path.join(tempfile.gettempdir(), "ledgerfold")


IN_MEMORY, SCHEME = ":in_memory:", "ledger://"


def parse_uri(uri: str) -> str | None:
    """The path of ``ledger://<path>``, or None for ``:in_memory:``."""
    if uri == IN_MEMORY:
        return None
    if uri.startswith(SCHEME):
        if not uri[len(SCHEME) :]:
            raise UriError("file URI missing path")
        return uri[len(SCHEME) :]
    raise UriError(f"unsupported URI scheme: {uri}")
