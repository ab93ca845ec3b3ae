"""A repository on a Hadoop file system: the metadata tables and the object store as Parquet under one root.

A table's rows lie in folders below data/. The file with the highest number in live/ lists the folders that hold
them now and, for a partitioned table, the partitions that don't count any more. A change writes its folders first
and then that file, under a temporary name that is renamed, so readers see the old rows or the new ones, whenever a
writer dies. A writer claims the next number first; two at once can't both have it, and the second one gets an error.
Rows that are only added go to the last folder as more files.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import ConcurrentWriteError
from ..operators import metadata
from .session import ship

MARK = ".chunkwell"
#: The partition column of large tables.
PARTITIONED = {"objects": "prefix", "chunk_refs": "commit_hash", "merkle_nodes": "commit_hash"}
#: Folders of a table from which a change rewrites all of it.
MAX_FOLDERS = 16


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        """root: the repository's folder or its metadata folder, a path of any file system that Spark reads."""
        ship(spark)
        self.spark = spark
        root = root.rstrip("/")
        self.root = root if root.endswith(f"/{MARK}") or root == MARK else f"{root}/{MARK}"
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read: dict[str, int] = {}  # the version of each table that was read last

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # ---- versions

    def _versions(self, name: str) -> list[int]:
        live = self._path(f"{self.root}/{name}/live")
        names = [s.getPath().getName() for s in self._fs.listStatus(live)] if self._fs.exists(live) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _folders(self, name: str, version: int) -> list[dict]:
        stream = self._fs.open(self._path(f"{self.root}/{name}/live/{version:09d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _now(self, name: str) -> tuple[int, list[dict]]:
        versions = self._versions(name)
        return (versions[-1], self._folders(name, versions[-1])) if versions else (0, [])

    def _put(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def _publish(self, name: str, folders: list[dict], purge: bool) -> None:
        """Make folders the table, if nobody has changed it since it was read here. What only older versions hold is
        removed; the version before this one stays for those who read it now, unless purge."""
        there = self._versions(name)
        version = self._read.get(name, there[-1] if there else 0) + 1
        claim, part, place = (self._path(f"{self.root}/{name}/live/{version:09d}{x}") for x in (".claim", ".part", ""))
        try:
            self._put(claim, "")
        except Py4JJavaError as e:
            raise ConcurrentWriteError(f"table {name} is being changed by another writer, or one died there: see {claim}") from e
        if there and there[-1] >= version:
            self._fs.delete(claim, False)
            raise ConcurrentWriteError(f"table {name} was changed by another writer")
        self._put(part, json.dumps(folders))
        if not self._fs.rename(part, place):
            raise ConcurrentWriteError(f"table {name}: {place} can't be made")
        self._read[name] = version
        old = [v for v in there if purge or v < version - 1]
        needed = {f["folder"] for f in folders} | {f["folder"] for v in there if v not in old for f in self._folders(name, v)}
        for v in old:
            for f in self._folders(name, v):
                if f["folder"] not in needed:
                    self._fs.delete(self._path(f"{self.root}/{name}/data/{f['folder']}"), True)
            for x in ("", ".claim"):
                self._fs.delete(self._path(f"{self.root}/{name}/live/{v:09d}{x}"), False)
        if purge:
            for f in folders:
                for value in f["without"]:
                    self._fs.delete(self._path(f"{self.root}/{name}/data/{f['folder']}/{PARTITIONED[name]}={value}"), True)

    def _write(self, name: str, folder: str, rows: DataFrame | None) -> None:
        path = f"{self.root}/{name}/data/{folder}"
        if rows is not None:
            writer = rows.select(*(f.name for f in schemas.schema(name))).write.mode("append")
            (writer.partitionBy(PARTITIONED[name]) if name in PARTITIONED else writer).parquet(path)
        self._fs.mkdirs(self._path(path))  # a partitioned table without rows still needs its folder

    # ---- tables

    def exists(self) -> bool:
        return bool(self._versions("config"))

    def create(self) -> None:
        """Empty tables with their schemas, where they don't exist; the chunker's signature is recorded."""
        for name in schemas.TABLES:
            if not self._versions(name):
                folder = uuid.uuid4().hex
                self._write(name, folder, None)
                self._publish(name, [{"folder": folder, "without": []}], False)
        rows = metadata.verify_signature(self.read("repo_meta"))
        if not rows.isEmpty():
            self.upsert("repo_meta", rows)

    def check(self) -> None:
        """FileNotFoundError without a repository; FormatMismatchError if another chunker made it."""
        if not self.exists():
            raise FileNotFoundError(f"no repository at {self.root}")
        metadata.verify_signature(self.read("repo_meta"))

    def read(self, name: str) -> DataFrame:
        version, folders = self._now(name)
        if not version:
            raise FileNotFoundError(f"no table {name} at {self.root}")
        self._read[name] = version
        out = None
        for f in folders:
            one = self.spark.read.schema(schemas.schema(name)).parquet(f"{self.root}/{name}/data/{f['folder']}")
            if f["without"]:
                one = one.where(~F.col(PARTITIONED[name]).isin(f["without"]))
            out = one if out is None else out.unionByName(one)
        return out

    def replace(self, name: str, rows: DataFrame, purge: bool = False) -> None:
        """rows instead of the table's."""
        folder = uuid.uuid4().hex
        self._write(name, folder, rows)
        self._publish(name, [{"folder": folder, "without": []}], purge)

    def append(self, name: str, rows: DataFrame) -> None:
        """rows beside the table's: no row that is there is written again."""
        self._write(name, self._now(name)[1][-1]["folder"], rows)

    def replace_partitions(self, name: str, values: list[str], rows: DataFrame | None = None) -> None:
        """rows instead of those of some partitions, whose files are removed; the other partitions aren't touched."""
        folders, folder = self._now(name)[1], uuid.uuid4().hex
        self._write(name, folder, rows)
        now = [f | {"without": sorted({*f["without"], *values})} for f in folders] + [{"folder": folder, "without": []}]
        self._publish(name, now, purge=True)
        if len(now) > MAX_FOLDERS:
            self.replace(name, self.read(name), purge=True)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.replace(name, metadata.upsert(self.read(name), rows, schemas.KEYS[name]))

    def ignore(self, name: str, rows: DataFrame, order: str) -> None:
        """Add the rows with new keys, of each the first in order."""
        self.append(name, metadata.new_rows(self.read(name), rows, schemas.KEYS[name], order))

    def config(self, key: str, default: str | None = None) -> str | None:
        return metadata.lookup(self.read("config"), key, default)

    def set_config(self, key: str, value: str) -> None:
        self.upsert("config", self.spark.createDataFrame([(key, value)], schemas.CONFIG))
