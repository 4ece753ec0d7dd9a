"""Tables of cases that are changed by commits: rows are staged first, then one new version makes them all visible.

Every table has a ``case_id`` and is kept in buckets of it. A change set may take cases out of any of the tables and
add rows to them. Its rows are written below a folder of their own run; only the buckets that lose rows are rewritten,
the others get the run's files beside those that they have. The version file, which names the runs of each bucket, is
written last and under a name that no two writers can both create: a job that dies before that leaves the tables as
they were, and a writer that another one has overtaken is told so.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
BUCKET = "bucket"


class Overtaken(RuntimeError):
    """Another commit came first; stage the change again, upon the tables as they are now."""


@dataclass(frozen=True)
class Change:
    """Cases (``case_id``) whose rows go from a table, and rows that come to it."""

    table: str
    remove: DataFrame | None = None
    add: DataFrame | None = None


@dataclass(frozen=True)
class Staged:
    base: int
    tables: dict[str, dict[str, list[str]]]


class CaseStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schemas: dict[str, StructType], buckets: int = BUCKETS) -> CaseStore:
        """An empty store; every schema has a ``case_id``."""
        if any("case_id" not in s.names for s in schemas.values()):
            raise ValueError("every table needs a case_id")
        store = cls(spark, folder)
        store._write(0, {"buckets": buckets, "schemas": {n: s.jsonValue() for n, s in schemas.items()}, "tables": {n: {} for n in schemas}})
        return store

    # Files, by Hadoop's file systems, as the tables may lie in any of them.

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _write(self, version: int, content: dict) -> None:
        """The version file: under a name of its own first, then renamed, which fails if that version is there."""
        files, name = self._files(), f"{version:012d}.json"
        draft, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", name)
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Overtaken(f"version {version} of {self.folder} is there already")

    def version(self) -> int:
        return max(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith("."))

    def state(self, version: int | None = None) -> dict:
        """What a version (the newest, if none is named) holds: runs of each bucket of each table."""
        path = self._path("versions", f"{self.version() if version is None else version:012d}.json")
        rows = self.spark.read.option("wholetext", True).text(path.toString()).collect()
        return json.loads(rows[0][0])

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col("case_id").cast("string")), F.lit(buckets)).cast("int")

    def _rows(self, state: dict, table: str, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schemas"][table])
        paths = [f"{self.folder}/{table}/{run}/{BUCKET}={b}" for b, runs in state["tables"][table].items() if only is None or b in only for run in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table; a version stays readable until ``clean``."""
        return self._rows(self.state(version), table)

    def stage(self, *changes: Change) -> Staged:
        """Write the rows of a change set; nothing of it is visible yet.

        Nulls: rows without a case_id are rows of one bucket, and no removal meets them. Repeated rows stay. Cases to
        remove that are not there are ignored. Added columns are matched by name.
        """
        base = self.version()
        state = self.state(base)
        tables = {n: {b: list(runs) for b, runs in t.items()} for n, t in state["tables"].items()}
        for change in changes:
            run, bucket = f"run-{uuid.uuid4().hex}", self._bucket(state["buckets"])
            names = StructType.fromJson(state["schemas"][change.table]).names
            parts, lost = [], set()
            if change.remove is not None:
                gone = change.remove.select("case_id").where("case_id IS NOT NULL").distinct()
                lost = {str(r[0]) for r in gone.select(bucket).distinct().collect()} & {*tables[change.table]}  # at most one row a bucket
                if lost:
                    now = self._rows({**state, "tables": tables}, change.table, lost)
                    parts.append(now.join(gone, "case_id", "left_anti").select(*names))
            if change.add is not None:
                parts.append(change.add.select(*names))
            for b in lost:
                del tables[change.table][b]
            if not parts:
                continue
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            # Small buckets share a task, and a bucket with a hot case is split over several.
            rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{change.table}/{run}")
            for name in self._names(change.table, run):
                if name.startswith(f"{BUCKET}="):
                    tables[change.table].setdefault(name.partition("=")[2], []).append(run)
        return Staged(base, tables)

    def publish(self, staged: Staged) -> int:
        """Make a staged change set visible, all at once; returns the new version."""
        if self.version() != staged.base:
            raise Overtaken(f"{self.folder} is past version {staged.base}")
        self._write(staged.base + 1, {**self.state(staged.base), "tables": staged.tables})
        return staged.base + 1

    def commit(self, *changes: Change) -> int:
        return self.publish(self.stage(*changes))

    def clean(self) -> int:
        """Delete the files that the newest version does not name, and older versions; returns how many runs went. No commit may be under way."""
        files, version = self._files(), self.version()
        tables, gone = self.state(version)["tables"], 0
        for table, buckets in tables.items():
            used = {run for runs in buckets.values() for run in runs}
            for run in self._names(table):
                if run not in used:
                    files.delete(self._path(table, run), True)
                    gone += 1
        for name in self._names("versions"):
            if name != f"{version:012d}.json":
                files.delete(self._path("versions", name), False)
        return gone
