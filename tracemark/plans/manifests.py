"""Snapshots of a folder of Parquet tables: numbered lists of the folders that make up each table.

A job writes new folders with as many tasks as it likes and then commits one list, so that all it wrote counts at once or not at all.
Folders never change. What is replaced stays until vacuum(), so that readers of an older list go on. One writer at a time; a second
one that began from the same list fails at its commit.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# {table: {folder: buckets of it that no longer count}}
Tables = dict[str, dict[str, list[int]]]


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm

    def fs(self, path: str):
        path = self._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, root = self.fs(f"{self.root}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self, number: int) -> Tables:
        fs, path = self.fs(f"{self.root}/manifests/{number:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, Tables]:
        """The last list and its number; 0 and nothing before the first."""
        numbers = self._numbers()
        return (numbers[-1], self._read(numbers[-1])) if numbers else (0, {})

    def commit(self, base: int, tables: Tables) -> int:
        """Put a list after list `base` in force. It is written aside and renamed, so it is there whole or not at all."""
        name = f"{self.root}/manifests/{base + 1:010d}.json"
        fs, final = self.fs(name)
        aside = self.fs(f"{self.root}/manifests/.{uuid.uuid4().hex}")[1]
        out = fs.create(aside)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise RuntimeError("another writer has committed in the meantime")
        return base + 1

    def new_folder(self, table: str) -> str:
        return f"{table}/part={uuid.uuid4().hex}"

    def read(self, table: str, schema: str, tables: Tables | None = None) -> DataFrame:
        """A table's rows; by default of the list in force. Bucketed tables have the columns part, version and bucket too."""
        held = (tables if tables is not None else self.current()[1]).get(table, {})
        empty = self.spark.createDataFrame([], schema)
        if not held:
            return empty
        reader = self.spark.read.schema(schema)
        rows = (reader.option("basePath", f"{self.root}/{table}") if "part" in empty.columns else reader).parquet(*[f"{self.root}/{f}" for f in sorted(held)])
        gone = [(F.col("part") == f.rpartition("=")[2]) & F.col("bucket").isin(buckets) for f, buckets in held.items() if buckets]
        return rows.filter(~reduce(Column.__or__, gone)) if gone else rows

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last `keep` lists names, and the older lists; what a stopped job left goes too. Returns
        how many folders were deleted. Not while a writer runs, nor a reader of an older list."""
        numbers = self._numbers()
        lists = {n: self._read(n) for n in numbers[-keep:]}
        named = {f for tables in lists.values() for held in tables.values() for f in held}
        gone = 0
        fs, root = self.fs(self.root)
        for table in [x.getPath() for x in fs.listStatus(root) if x.isDirectory()]:
            for part in [x.getPath() for x in fs.listStatus(table) if x.getPath().getName().startswith("part=")]:
                if f"{table.getName()}/{part.getName()}" not in named:
                    gone += fs.delete(part, True)
        for n in numbers[:-keep]:
            fs.delete(self.fs(f"{self.root}/manifests/{n:010d}.json")[1], False)
        return gone

    def size(self, *tables: str) -> int:
        """Bytes of what tables hold in the list in force, with buckets of theirs that no longer count."""
        held = self.current()[1]
        return sum(fs.getContentSummary(path).getLength() for t in tables for f in held.get(t, {}) for fs, path in [self.fs(f"{self.root}/{f}")])
