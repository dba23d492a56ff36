"""Tables that change together: copy-on-write by bucket under a log of snapshots.

A snapshot names, for every table, the folders of each of its buckets; rows are dealt to buckets by a hash of their
key. A change writes new folders for the buckets it touches (a delete or merge rewrites those, an append adds one) and
becomes visible by one new entry in the log, for all tables at once: readers see all of it or nothing, and go on
reading the snapshot that they began with. Nothing is ever written to a folder that a snapshot names.

Writers don't wait for each other. A change is based on the snapshot it began with; if the log has moved on at its commit and
what it read or rewrote has changed since, it is refused with ``Conflict`` and can be tried again (``apply``); else it
is joined to the newest snapshot. An entry is made by a rename that refuses an existing name, which is one step in a
store such as HDFS.

The log's entries are small: a line a bucket and table. Rows are read, joined and written by Spark alone.

Cases: a null key is in a bucket like any value and is never deleted or merged by a null; deleting or merging nothing
changes no folder; of rows that repeat a key in a merge's input one is kept; tables may be empty.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.activity import redacted

BUCKETS = 32


class Conflict(Exception):
    """Another writer changed what this change read or rewrote."""


@dataclass
class Table:
    key: str
    buckets: int
    schema: dict
    #: Folders of each bucket that has any.
    parts: dict[str, list[str]] = field(default_factory=dict)


class Snapshots:
    """A log of snapshots and its tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        log = self._path("_snapshots")
        names = [s.getPath().getName() for s in self._files.listStatus(log)] if self._files.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def tables(self, version: int | None = None) -> tuple[int, dict[str, Table]]:
        """A snapshot's number, by default the newest's, and its tables; 0 before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/_snapshots/{version:020d}.json", wholetext=True).first()[0]
        return version, {name: Table(**t) for name, t in json.loads(text)["tables"].items()}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as a snapshot has it."""
        return self._rows(name, self.tables(version)[1][name]).drop("_write", "_bucket")

    def _rows(self, name: str, table: Table, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, by default of all, with their ``_bucket``; other buckets' folders aren't listed."""
        schema = T.StructType.fromJson(table.schema)
        names = table.parts if buckets is None else [str(b) for b in buckets if str(b) in table.parts]
        folders = [f"{self.root}/data/{name}/{f}" for b in names for f in table.parts[b]]
        wide = T.StructType([*schema.fields, T.StructField("_write", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], wide)
        return self.spark.read.schema(wide).option("basePath", f"{self.root}/data/{name}").parquet(*folders)

    def change(self) -> Change:
        return Change(self)

    def apply(self, make: Callable[[Change], None], attempts: int = 5) -> int:
        """Commit what ``make`` does to a change, made anew from the newest snapshot after a conflict."""
        for left in range(attempts - 1, -1, -1):
            change = self.change()
            make(change)
            try:
                return change.commit()
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be at least 1")

    def _publish(self, version: int, tables: dict[str, Table], note: str) -> bool:
        """Whether the entry could be made; False if the number is taken."""
        entry = {"version": version, "at": time.time(), "note": note, "tables": {n: vars(t) for n, t in tables.items()}}
        draft, target = self._path(f"_snapshots/_draft-{uuid.uuid4().hex}"), self._path(f"_snapshots/{version:020d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        context = self._fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Remove the snapshots before the newest ``keep`` and the folders that only they name; returns the number of folders.

        Changes that are being written have folders that no snapshot names yet: run it while there are none.
        """
        versions = self.versions()
        named = {f"{n}/{f}" for v in versions[-keep:] for n, t in self.tables(v)[1].items() for part in t.parts.values() for f in part}
        gone = 0
        for table in self._files.listStatus(self._path("data")) if versions else []:
            for write in self._files.listStatus(table.getPath()):
                for part in self._files.listStatus(write.getPath()):
                    name = "/".join(p.getPath().getName() for p in (table, write, part))
                    if part.isDirectory() and name not in named:
                        self._files.delete(part.getPath(), True)
                        gone += 1
        for v in versions[:-keep]:
            self._files.delete(self._path(f"_snapshots/{v:020d}.json"), False)
        return gone


class Change:
    """Changes to several tables that become visible together."""

    def __init__(self, log: Snapshots):
        self.log = log
        self.base, self.tables = log.tables()
        #: What must not have changed since: tables as a whole, or (table, bucket).
        self._whole: set[str] = set()
        self._held: set[tuple[str, str]] = set()
        #: Folders that replace those of a bucket, folders added to one, and tables made here.
        self._new: dict[tuple[str, str], list[str]] = {}
        self._added: dict[tuple[str, str], list[str]] = {}
        self._made: dict[str, Table] = {}

    def _table(self, name: str) -> Table:
        return self._made.get(name) or self.tables[name]

    def _now(self, name: str) -> Table:
        """The table with what this change has done so far."""
        table = self._table(name)
        parts = {b: list(f) for b, f in table.parts.items()} | {b: f for (n, b), f in self._new.items() if n == name}
        for (n, b), folders in self._added.items():
            if n == name:
                parts[b] = [*parts.get(b, []), *folders]
        return Table(table.key, table.buckets, table.schema, {b: f for b, f in parts.items() if f})

    @staticmethod
    def _bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, table: Table) -> dict[str, list[str]]:
        """Write rows of any buckets; the folder of each bucket that has some."""
        fields = T.StructType.fromJson(table.schema).fieldNames()
        write = f"_write={uuid.uuid4().hex}"
        target = f"{self.log.root}/data/{name}/{write}"
        placed = rows.select(*[F.col(f"`{c}`") for c in fields]).withColumn("_bucket", self._bucket(F.col(f"`{table.key}`"), table.buckets))
        placed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(target)
        found = [s.getPath().getName() for s in self.log._files.listStatus(self.log._fs.Path(target))]
        return {n.removeprefix("_bucket="): [f"{write}/{n}"] for n in found if n.startswith("_bucket=")}

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of the table whose key may be in ``keys`` (one column): those of its keys' buckets, no others are read."""
        now = self._now(name)
        there = [r[0] for r in keys.select(self._bucket(F.col(keys.columns[0]), now.buckets)).distinct().collect()]  # at most the buckets
        return self.log._rows(name, now, there).drop("_write", "_bucket")

    def depends(self, name: str) -> None:
        """This change holds only if nobody changes the table meanwhile."""
        self._whole.add(name)

    def create(self, name: str, rows: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        if name in self.tables or name in self._made:
            raise ValueError(f"there is a table {name}")
        self._made[name] = Table(key, buckets, rows.schema.jsonValue())
        self.append(name, rows)

    def append(self, name: str, rows: DataFrame) -> None:
        for bucket, folders in self._write(name, rows, self._table(name)).items():
            self._added[name, bucket] = [*self._added.get((name, bucket), []), *folders]

    def _replace(self, name: str, buckets: list[int], rows: DataFrame) -> None:
        """``rows`` stand for all rows of the buckets from now on."""
        written = self._write(name, rows, self._table(name)) if buckets else {}
        for bucket in map(str, buckets):
            self._new[name, bucket] = written.get(bucket, [])
            self._added.pop((name, bucket), None)
            self._held.add((name, bucket))

    def delete(self, name: str, gone: DataFrame, on: str | None = None) -> None:
        """Rows whose ``on`` (by default the key) is in ``gone``; only buckets that hold such a row are rewritten."""
        now = self._now(name)
        on = on or now.key
        ids = gone.select(F.col(on)).where(F.col(on).isNotNull()).distinct()
        if on == now.key:
            able = [r[0] for r in ids.select(self._bucket(F.col(on), now.buckets)).distinct().collect()]  # at most the buckets
            self._held |= {(name, str(b)) for b in able}
        else:
            able = None
            self._whole.add(name)
        rows = self.log._rows(name, now, able)
        touched = sorted(r[0] for r in rows.join(ids, on, "left_semi").select("_bucket").distinct().collect())
        self._replace(name, touched, rows.where(F.col("_bucket").isin(touched)).join(ids, on, "left_anti"))

    def merge(self, name: str, rows: DataFrame) -> None:
        """Rows take the place of those with their key, or are added; only their keys' buckets are rewritten."""
        now = self._now(name)
        fresh = rows.dropDuplicates([now.key])
        touched = sorted(r[0] for r in fresh.select(self._bucket(F.col(now.key), now.buckets)).distinct().collect())
        old = self.log._rows(name, now, touched).join(fresh.select(now.key), now.key, "left_anti").drop("_write", "_bucket")
        self._replace(name, touched, old.unionByName(fresh.select(*old.columns)))

    def compact(self, name: str, most: int = 8) -> None:
        """Buckets of more than ``most`` folders become one folder each."""
        now = self._now(name)
        many = sorted(int(b) for b, folders in now.parts.items() if len(folders) > most)
        self._replace(name, many, self.log._rows(name, now, many))

    def commit(self, note: str = "") -> int:
        """Make all of it visible as a new snapshot; its number. Nothing to do makes none."""
        if not (self._new or self._added or self._made):
            return self.base
        while True:
            version, tables = self.log.tables()
            was = lambda t, b: self.tables[t].parts.get(b) if t in self.tables else None
            for name in self._made:
                if name in tables:
                    raise Conflict(f"{name} was made meanwhile")
            for name in self._whole - set(self._made):
                if name not in tables or tables[name].parts != self.tables[name].parts:
                    raise Conflict(f"{name} was changed meanwhile")
            for name, bucket in self._held:
                if name not in self._made and (name not in tables or tables[name].parts.get(bucket) != was(name, bucket)):
                    raise Conflict(f"bucket {bucket} of {name} was changed meanwhile")
            tables |= {n: Table(t.key, t.buckets, t.schema) for n, t in self._made.items()}
            for (name, bucket), folders in self._new.items():
                tables[name].parts[bucket] = list(folders)
            for (name, bucket), folders in self._added.items():
                tables[name].parts[bucket] = [*tables[name].parts.get(bucket, []), *folders]
            for table in tables.values():
                table.parts = {b: f for b, f in table.parts.items() if f}
            if self.log._publish(version + 1, tables, note):
                return version + 1


def append_log(log: Snapshots, table: str, events: DataFrame, allowed: tuple[str, ...], key: str) -> int:
    """Append events to a stored log, whose columns are those of ``allowed`` alone; its snapshot's number.

    What isn't allowed by name, such as texts and keys, never reaches the store. Appends of several writers all stay.
    """
    rows = redacted(events, allowed)

    def add(change: Change) -> None:
        if table in change.tables:
            change.append(table, rows)
        else:
            change.create(table, rows, key)

    return log.apply(add)


def cascade(log: Snapshots, gone: DataFrame, tables: dict[str, str], attempts: int = 5) -> int:
    """Delete from all ``tables`` (name: its column) the rows of what ``gone`` names, in one snapshot.

    ``gone`` has one column, under which it is looked up in each table's own column.
    """
    only = gone.columns[0]

    def make(change: Change) -> None:
        for name, column in tables.items():
            change.delete(name, gone.select(F.col(only).alias(column)), column)

    return log.apply(make, attempts)
