"""Parquet tables in versions that are published by one atomic rename.

A ``Store`` holds some partitioned tables.  Rows are written to folders of their own,
``<root>/data/<table>/<column>=<value>/write_id=<id>``, which no reader knows yet.  A
manifest names the folders that make up each partition of each table; it is written
beside the others and renamed to ``<root>/versions/<n>``, which fails if another
writer got there first.  So a change of several partitions and tables is there as a
whole or not at all, a crash in between leaves the old version as it was, and readers
of an old version keep their files.  Manifests hold one entry for each folder, never
rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has published since the change began."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the published versions, ascending."""
        fs, folder = self._fs(), self._path("versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest if none is named."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "tables": {}, "notes": {}}
            version = known[-1]
        stream = self._fs().open(self._path("versions", f"{version:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # -- readers ----------------------------------------------------------------
    def partitions(self, table: str, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"].get(table, {"parts": {}})["parts"])

    def read(self, table: str, partitions: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table in a version (the newest if none is named), of the named
        partitions alone if given: no other folder is listed or opened."""
        return self._read(self.manifest(version)["tables"][table], table, partitions)

    def _read(self, spec: dict, table: str, partitions: list[str] | None) -> DataFrame:
        column, schema = spec["column"], StructType.fromJson(spec["schema"])
        wanted = spec["parts"] if partitions is None else {p: spec["parts"][p] for p in partitions if p in spec["parts"]}
        base = f"{self.root}/data/{table}"
        paths = [f"{base}/{column}={p}/write_id={w}" for p, writes in wanted.items() for w in writes]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = StructType([*[f for f in schema.fields if f.name != column], schema[column],
                           StructField("write_id", StringType())])
        rows = self.spark.read.schema(full).option("basePath", base).parquet(*paths)
        return rows.select(*[f"`{c}`" for c in schema.names])

    def change(self) -> "Change":
        return Change(self)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` versions names, and older
        manifests.  Run it when no writer is at work: it can't tell an abandoned write
        from one under way.  Returns the number of folders deleted."""
        if keep < 1:
            raise ValueError("keep at least one version")
        fs, known, gone = self._fs(), self.versions(), 0
        live = {(t, p, w) for v in known[-keep:] for t, s in self.manifest(v)["tables"].items()
                for p, writes in s["parts"].items() for w in writes}
        if known and fs.exists(self._path("data")):
            for s in fs.globStatus(self._path("data", "*", "*", "write_id=*")) or []:
                path = s.getPath()
                part = path.getParent()
                key = (part.getParent().getName(), part.getName().split("=", 1)[1], path.getName().split("=", 1)[1])
                if key not in live:
                    gone += bool(fs.delete(path, True))
        for v in known[:-keep]:
            fs.delete(self._path("versions", f"{v:010d}"), False)
        return gone


class Change:
    """A change of a store: rows are written as they are given, and all of it becomes
    the next version with ``publish``."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.next = json.loads(json.dumps(self.base))

    def _spec(self, table: str, rows: DataFrame, column: str) -> dict:
        spec = self.next["tables"].setdefault(
            table, {"column": column, "schema": rows.schema.jsonValue(), "parts": {}})
        have, given = StructType.fromJson(spec["schema"]), rows.schema
        if spec["column"] != column or [(f.name, f.dataType) for f in have] != [(f.name, f.dataType) for f in given]:
            raise ValueError(f"{table}: rows of another schema or partition column")
        return spec

    def append(self, table: str, rows: DataFrame, column: str) -> dict[str, int]:
        """Add rows; returns how many went to each partition.  Spark writes a partition
        with as many tasks as its size asks for."""
        spec, write_id = self._spec(table, rows, column), uuid.uuid4().hex
        base = f"{self.store.root}/data/{table}"
        (rows.withColumn("write_id", F.lit(write_id)).hint("rebalance", column).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(column, "write_id").parquet(base))
        found = self.store._fs().globStatus(self.store._path("data", table, "*", f"write_id={write_id}")) or []
        names = [s.getPath().getParent().getName().split("=", 1)[1] for s in found]
        for name in names:
            spec["parts"].setdefault(name, {})[write_id] = None
        written = self.store._read({**spec, "parts": {n: [write_id] for n in names}}, table, None)
        counts = {r["p"]: r["n"] for r in written.groupBy(F.col(column).cast("string").alias("p")).agg(
            F.count(F.lit(1)).alias("n")).collect()}     # one row a partition
        counts = {NO_VALUE if p is None else p: n for p, n in counts.items()}
        for name in names:
            spec["parts"][name][write_id] = counts[name]
        return counts

    def read(self, table: str, partitions: list[str] | None = None) -> DataFrame:
        """The rows of a table as they are with what was changed up to here."""
        return self.store._read(self.next["tables"][table], table, partitions)

    def drop(self, table: str, partitions: list[str]) -> int:
        """Leave partitions out of the next version; returns their number of rows."""
        parts = self.next["tables"].get(table, {"parts": {}})["parts"]
        return sum(sum(parts.pop(p).values()) for p in partitions if p in parts)

    def replace(self, table: str, rows: DataFrame, column: str, partitions: list[str]) -> dict[str, int]:
        """Rows in place of all those of the named partitions; the others stay as they
        are, unread.  The rows may be computed from the old ones, whose files stay."""
        self._spec(table, rows, column)
        self.drop(table, partitions)
        counts = self.append(table, rows, column)
        if not set(counts) <= set(partitions):
            raise ValueError(f"{table}: rows of partitions {sorted(set(counts) - set(partitions))}, which are not replaced")
        return counts

    def note(self, key: str, value) -> None:
        """A small value (JSON) that belongs to the version, such as a stream's place."""
        self.next["notes"][key] = value

    def publish(self) -> int:
        """Make the change the next version; ``Conflict`` if there is one already."""
        store = self.store
        version = self.base["version"] + 1
        self.next["version"] = version
        fs = store._fs()
        fs.mkdirs(store._path("versions"))
        made = store._path("versions", f".{version:010d}-{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        try:
            stream.write(bytearray(json.dumps(self.next).encode()))
        finally:
            stream.close()
        jvm = store.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), store.spark._jsc.hadoopConfiguration())
        none = store.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(made, store._path("versions", f"{version:010d}"), none)
        except Exception as error:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} of {store.root} was published by another writer") from error
            raise
        self.base = json.loads(json.dumps(self.next))
        return version
