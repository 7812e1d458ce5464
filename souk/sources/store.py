"""A table store over Parquet with atomic versions and keyed merges.

A table is a folder with data segments and a manifest for each version; a version is committed by creating
its manifest, which fails if another writer was first. Every writer pins the version that it has read and commits
the next one; if that is taken it starts again from the newer version, so no commit is lost. Appends add a segment.
Keyed tables are split into buckets by the hash of their key, as many as their size asks for, and a merge rewrites
only the buckets that it touches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators import cdc

#: Buckets of a keyed table at first, and the bytes of one from which on a merge doubles their number.
BUCKETS, BUCKET_BYTES = 32, 256 << 20
ATTEMPTS = 20
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class TableStore:
    """Tables by name under a root folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self, name: str) -> list[int]:
        at = self._path(f"{self.root}/{name}/_versions")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self, name: str) -> int | None:
        """The latest committed version, None for no table."""
        return (self._manifests(name) or [None])[-1]

    def _manifest(self, name: str, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}/_versions/{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, version: int, manifest: dict) -> int:
        at = self._path(f"{self.root}/{name}/_versions/{version:08d}.json")
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            raise Conflict(f"{name}: version {version} is there already") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return version

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A version of the table, the latest by default; of a keyed table, some buckets."""
        version = self.version(name) if version is None else version
        if version is None:
            raise KeyError(f"no table {name!r}")
        m = self._manifest(name, version)
        schema = T.StructType.fromJson(m["schema"])
        paths = [p for b, ps in m["files"].items() if buckets is None or int(b) in buckets for p in ps]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in paths])

    def views(self, prefix: str = "") -> list[str]:
        """Registers the latest version of every table as a temporary view; returns their names."""
        at = self._path(self.root)
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        names = sorted(n for n in found if self.exists(n))
        for n in names:
            self.read(n).createOrReplaceTempView(prefix + n)
        return [prefix + n for n in names]

    def overwrite(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new version with these rows alone; its schema may differ."""
        segment = self._segment(name, df, partition_by)
        return self._until_committed(name, lambda base: (self._manifest_of(df, None, [segment]), None))[0]

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new version with these rows added as one segment; nothing is rewritten. New columns are null in older rows."""
        segment = self._segment(name, df, partition_by)
        return self._until_committed(name, lambda base: (self._manifest_of(df, base and self._manifest(name, base), [segment]), None))[0]

    def _segment(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        segment = f"s-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.root}/{name}/{segment}")
        return segment

    def _manifest_of(self, df: DataFrame, old: dict | None, segments: list[str]) -> dict:
        """Of a table that isn't keyed: all files of the old one, then the segments."""
        files, fields = list(segments), list(df.schema.fields)
        if old:
            files = [p for ps in old["files"].values() for p in ps] + files
            before = T.StructType.fromJson(old["schema"]).fields
            fields = before + [f for f in fields if f.name not in {b.name for b in before}]
        return {"schema": T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]).jsonValue(), "files": {"-1": files}}

    def _until_committed(self, name: str, plan: Callable[[int | None], tuple[dict | None, object]]) -> tuple[int, object]:
        """Commits what ``plan`` makes of the latest version as the next one, again and again until no other writer was first.

        A plan without a manifest commits nothing. Returns the version and what else the plan gave.
        """
        for _ in range(ATTEMPTS):
            base = self.version(name)
            manifest, extra = plan(base)
            if manifest is None:
                return base, extra
            try:
                return self._commit(name, (base or 0) + 1, manifest), extra
            except Conflict:
                continue
        raise Conflict(f"{name}: {ATTEMPTS} other writers were first")

    def insert_absent(self, name: str, df: DataFrame, keys: list[str], partition_by: list[str] | None = None, within: tuple[str, str] | None = None) -> int:
        """Appends the rows whose keys the table lacks, one a key; returns how many. Running it again adds none.

        ``within`` (a moment's column, an interval as "2 DAYS") bounds what is read of the table to rows at most so much
        older than the oldest of ``df``: copies that lie further apart are then not known. Without it all keys are read.
        """
        staged = self._segment(f"{name}/_staged", df.dropDuplicates(keys))
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/_staged/{staged}")

        def plan(base: int | None) -> tuple[dict | None, int]:
            if base is None:
                fresh, old = rows, None
            else:
                old, held = self._manifest(name, base), self.read(name, base)
                if within and (oldest := rows.agg(F.min(within[0])).first()[0]) is not None:
                    held = held.filter(F.col(within[0]) >= F.lit(oldest) - F.expr(f"INTERVAL {within[1]}"))
                fresh = cdc.absent(rows, held, keys)
            segment = self._segment(name, fresh, partition_by)
            n = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/{segment}").count()
            if not n and old is not None:
                self._fs.delete(self._path(f"{self.root}/{name}/{segment}"), True)
                return None, 0
            return self._manifest_of(df, old, [segment]), n

        try:
            return self._until_committed(name, plan)[1]
        finally:
            self._fs.delete(self._path(f"{self.root}/{name}/_staged/{staged}"), True)

    def _size(self, name: str, files: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._path(f"{self.root}/{name}/{p}")).getLength() for p in files)

    def merge(self, name: str, df: DataFrame, keys: list[str], plan: Callable[[DataFrame, DataFrame | None], DataFrame]) -> int:
        """Commits ``plan(source, target)`` for the buckets in which the source has rows; the other buckets stay as they are.

        A table that was appended to or overwritten, or whose buckets have grown beyond their size, is read whole
        and written in buckets anew.
        """

        def bucketed(rows: DataFrame, n: int) -> DataFrame:
            return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))

        def attempt(base: int | None) -> tuple[dict, None]:
            old = self._manifest(name, base) if base is not None else None
            files = old["files"] if old else {}
            n, whole = (old or {}).get("buckets", BUCKETS), "-1" in files
            size = self._size(name, [p for ps in files.values() for p in ps])
            while size > n * BUCKET_BYTES:
                n, whole = 2 * n, True
            touched = list(range(n)) if whole else [r[0] for r in bucketed(df, n).select(_BUCKET).distinct().collect()]
            result = plan(df, self.read(name, base, None if whole else touched) if old else None)
            segment = f"s-{uuid.uuid4().hex}"
            bucketed(result, n).repartition(max(1, len(touched)), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{name}/{segment}")
            files = {} if whole else {b: ps for b, ps in files.items() if int(b) not in touched}
            for s in self._fs.listStatus(self._path(f"{self.root}/{name}/{segment}")):
                if (folder := s.getPath().getName()).startswith(f"{_BUCKET}="):
                    files[folder.split("=")[1]] = [f"{segment}/{folder}"]
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in result.schema.fields])
            return {"schema": schema.jsonValue(), "files": files, "buckets": n}, None

        return self._until_committed(name, attempt)[0]

    def upsert(self, name: str, df: DataFrame, keys: list[str], sequence: str) -> int:
        """Current-state merge; see ``cdc.current_state``."""
        return self.merge(name, df, keys, lambda s, t: cdc.current_state(s, t, keys, sequence))

    def scd2(self, name: str, df: DataFrame, keys: list[str], tracked: list[str], effective: str, run_id: str, **how) -> DataFrame:
        """History merge; see ``cdc.scd2``. Returns the late rows, written before the version is swapped, from the same version."""
        written: list[tuple[str, T.StructType]] = []

        def plan(source: DataFrame, target: DataFrame | None) -> DataFrame:
            history = cdc.scd2(source, target, keys, tracked, effective, run_id, **how)
            path = f"{self.root}/{name}/_late/{uuid.uuid4().hex}"
            history.late.write.parquet(path)
            written.append((path, history.late.schema))
            return history.table

        self.merge(name, df, keys, plan)
        path, schema = written[-1]
        return self.spark.read.schema(schema).parquet(path)
