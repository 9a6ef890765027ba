"""Job, result, template and artifact tables: a snapshot in hash buckets and the rows that came after it, read as one.

A table is a folder of Parquet below any file system. Its manifest says which folder holds each bucket of the snapshot and which folders hold rows
that were appended since; a new manifest is a new file of the next number, so a reader has one state from beginning to end, whatever
is written meanwhile. Appending writes the new rows alone. Reading compares versions only of ids that were appended since, and a
look-up by the column of the buckets opens the buckets of its keys alone; Bloom filters and sorted rows narrow it within them.
Compaction rewrites the buckets that the appended rows fall into and leaves the others where they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.jobs import ARTIFACTS, JOBS, RESULTS, TEMPLATES, latest

TABLES = {"jobs": JOBS, "results": RESULTS, "templates": TEMPLATES, "artifacts": ARTIFACTS}
#: The column that a table's buckets go by: never changed by a new version of a row, and what most look-ups ask for.
BUCKET_BY = {"jobs": "idempotency_key", "results": "job_id", "templates": "domain", "artifacts": "job_id"}
#: Columns with a Bloom filter.
BLOOM = {"jobs": ("id", "idempotency_key"), "results": ("id", "job_id"), "templates": ("id", "domain"), "artifacts": ("id", "job_id")}
#: Rows of a bucket, about; appended folders after which a table is compacted; keys that a look-up names in its filter.
BUCKET_ROWS, MOST_DELTAS, NAMED_KEYS = 500_000, 24, 200


class Conflict(RuntimeError):
    """Another writer's manifest came first, again and again."""


@dataclass
class Manifest:
    """One state of a table: folders of buckets (by number) and of appended rows, below the table's own."""

    version: int = 0
    buckets: int = 0
    snapshot: dict[str, str] = field(default_factory=dict)
    deltas: list[str] = field(default_factory=list)

    def paths(self, numbers: list[int] | None = None) -> list[str]:
        """Folders of the snapshot's buckets, all or those of some numbers."""
        wanted = self.snapshot.keys() if numbers is None else [str(n) for n in numbers]
        return [f"{self.snapshot[n]}/bucket={n}" for n in wanted if n in self.snapshot]


class Store:
    """Four tables below a path of any file system. Writers append; an update is a new version of a row."""

    def __init__(self, spark: SparkSession, path: str, *, most_deltas: int = MOST_DELTAS, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.most_deltas, self.bucket_rows = spark, path.rstrip("/"), most_deltas, bucket_rows

    # --- Manifests ---------------------------------------------------------------------------------------------------

    def _at(self, name: str, *parts: str) -> str:
        return "/".join([self.path, name, *parts])

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(self._at(name, "_manifest"))
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def _read(self, name: str, version: int) -> Manifest:
        fs, p = self._fs(self._at(name, "_manifest", f"{version:012d}.json"))
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def manifest(self, name: str) -> Manifest:
        """The table as it is now."""
        versions = self._versions(name)
        return self._read(name, versions[-1]) if versions else Manifest()

    def _swap(self, name: str, change, tries: int = 20) -> Manifest:  # noqa: ANN001
        """Puts change(manifest) in the place of the manifest; if another writer was first, once more upon theirs."""
        for _ in range(tries):
            old = self.manifest(name)
            new = change(old)
            new.version = old.version + 1
            fs, p = self._fs(self._at(name, "_manifest", f"{new.version:012d}.json"))
            own = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name, "_manifest", f".{uuid.uuid4().hex}"))
            out = fs.create(own, False)
            out.write(json.dumps(vars(new)).encode())
            out.close()
            if not fs.exists(p) and fs.rename(own, p):  # a rename is whole or not at all
                return new
            fs.delete(own, False)
        raise Conflict(f"{name}: no manifest in {tries} tries")

    # --- Writing -----------------------------------------------------------------------------------------------------

    def migrate(self) -> None:
        """Makes the tables that are not there yet."""
        for name in TABLES:
            if not self._versions(name):
                self._swap(name, lambda m: m)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows, or new versions of rows; compacts the table when many folders have come together."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        folder = f"delta-{uuid.uuid4().hex}"
        rows.select(*columns).write.options(**self._bloom(name)).parquet(self._at(name, folder))
        now = self._swap(name, lambda m: Manifest(0, m.buckets, m.snapshot, [*m.deltas, folder]))
        if len(now.deltas) >= self.most_deltas:
            self.compact(name)

    def _bloom(self, name: str) -> dict[str, str]:
        return {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOM[name]}

    def _bucket(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(BUCKET_BY[name]), F.lit(""))), F.lit(n)).cast("int")

    def compact(self, name: str) -> Manifest:
        """Puts the appended rows into the snapshot. Only buckets with new rows are rewritten, unless the table has outgrown their number.

        Versions of a row but the latest are gone after it. Rows that are appended meanwhile stay appended.
        """
        old = self.manifest(name)
        if not old.deltas:
            return old
        n = max(old.buckets, 1)
        new_rows = self._folders(name, old.deltas)
        size = new_rows.count() + (self._folders(name, old.paths()).count() if old.snapshot else 0)
        while n * self.bucket_rows < size:
            n *= 2
        touched = None if n != old.buckets else [r.b for r in new_rows.select(self._bucket(name, n).alias("b")).distinct().collect()]  # a row a bucket at most
        base = old.paths(touched)
        rows = self._latest(name, self._folders(name, [*base, *old.deltas]))
        folder = f"snapshot-{uuid.uuid4().hex}"
        out = rows.withColumn("bucket", self._bucket(name, n)).hint("rebalance", "bucket").sortWithinPartitions("bucket", BUCKET_BY[name])  # a large bucket is several files
        out.write.options(**self._bloom(name)).partitionBy("bucket").parquet(self._at(name, folder))
        fs, p = self._fs(self._at(name, folder))
        written = [s.getPath().getName().split("=")[1] for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")]

        def change(m: Manifest) -> Manifest:
            if m.snapshot != old.snapshot:
                raise Conflict(f"{name}: compacted by another writer")
            kept = {} if touched is None else m.snapshot
            return Manifest(0, n, {**kept, **{b: folder for b in written}}, [d for d in m.deltas if d not in old.deltas])

        return self._swap(name, change)

    def vacuum(self, name: str, keep: int = 5) -> int:
        """Deletes folders that none of the last `keep` states refers to, and older manifests; how many. Readers of older states lose theirs."""
        versions = self._versions(name)
        states = [self._read(name, v) for v in versions[-keep:]]
        live = {f for m in states for f in (*m.snapshot.values(), *m.deltas)}
        fs, p = self._fs(self._at(name))
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(("delta-", "snapshot-")) and s.getPath().getName() not in live]
        for path in gone:
            fs.delete(path, True)
        for v in versions[:-keep]:
            fs.delete(self._fs(self._at(name, "_manifest", f"{v:012d}.json"))[1], False)
        return len(gone)

    # --- Reading -----------------------------------------------------------------------------------------------------

    def _folders(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(self._at(name, f) for f in folders))

    @staticmethod
    def _latest(name: str, rows: DataFrame) -> DataFrame:
        changed = "updated_at" if "updated_at" in TABLES[name] else "created_at"
        return latest(rows, ["id"], [changed])

    def versions(self, name: str) -> DataFrame:
        """Every version since the last compaction, and the latest of before."""
        m = self.manifest(name)
        return self._folders(name, [*m.paths(), *m.deltas])

    def _read_as_one(self, name: str, base: DataFrame | None, added: DataFrame | None) -> DataFrame:
        """Rows of the snapshot that nothing was appended to as they are; of the others the latest version."""
        if base is None or added is None:
            rows = base if added is None else self._latest(name, added)
            return self._folders(name, []) if rows is None else rows
        ids = added.select("id").distinct()
        again = self._latest(name, added.unionByName(base.join(ids, "id", "left_semi")))
        return base.join(ids, "id", "left_anti").unionByName(again)

    def table(self, name: str) -> DataFrame:
        """The latest version of each row."""
        m = self.manifest(name)
        return self._read_as_one(name, self._folders(name, m.paths()) if m.snapshot else None, self._folders(name, m.deltas) if m.deltas else None)

    def lookup(self, name: str, column: str, keys: DataFrame) -> DataFrame:
        """The latest versions of the rows with these values (of `keys`' first column) of `column`, which no version of a row changes.

        By the column of the buckets only the keys' buckets are opened. Few keys are named in the filter, so that Bloom filters and the
        ranges of row groups tell; many are joined. Null keys find nothing.
        """
        m = self.manifest(name)
        wanted = keys.select(F.col(keys.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct()
        numbers = None
        if column == BUCKET_BY[name] and m.buckets > 1:
            numbers = [r.b for r in wanted.select(self._bucket(name, m.buckets).alias("b")).distinct().collect()]  # a row a bucket at most
        few = [r[0] for r in wanted.limit(NAMED_KEYS + 1).collect()]
        narrow = (lambda df: df.where(F.col(column).isin(few))) if len(few) <= NAMED_KEYS else (lambda df: df.join(wanted, column, "left_semi").select(*df.columns))
        paths = m.paths(numbers)
        return self._read_as_one(name, narrow(self._folders(name, paths)) if paths else None, narrow(self._folders(name, m.deltas)) if m.deltas else None)

    def by_id(self, name: str, ids: DataFrame) -> DataFrame:
        """The latest versions of the rows with these ids (a column id); only their versions are compared."""
        return self.lookup(name, "id", ids.select("id"))

    def one(self, name: str, row_id: str) -> DataFrame:
        """The latest version of one row; the filter is pushed down to the files and their Bloom filters."""
        return self.lookup(name, "id", self.spark.createDataFrame([(row_id,)], "id string"))
