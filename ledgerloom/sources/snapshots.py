"""Tables that change together: snapshots of several tables, committed at once and read whole.

A snapshot is a manifest: for each table its schema, its keys and the files of each hash bucket. Files never change; a
transaction writes new ones, which no reader sees, and then the next manifest. That one file is the commit: it is written
beside and renamed to its number without overwriting, so of two writers one gets it. Readers take the greatest number, so
a writer that dies, between two tables or in the middle of one, leaves the former snapshot whole.

An upsert rewrites only the buckets that its batch has keys in; the files of all others stay, under their names. A commit that
finds newer snapshots goes on top of them if they changed none of the buckets it has read or written, and else raises Conflict.

Layout: manifests/<number>.json, data/<table>/<transaction>/_bucket=<k>/. Needs a file system whose rename does not
overwrite (HDFS, a local disk), as Spark's own streaming checkpoints do. What the driver holds is a manifest: its size follows
the number of files. Buckets should hold some 128 to 256 MB; a bucket is one task and one file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import upsert

BUCKET = "_bucket"
#: Keys by which the model's tables are bucketed.
KEYS = {"nodes": ["id"], "edges": upsert.EDGE_KEY, "facts": upsert.FACT_KEY, "aliases": ["alias_norm"], "reports": ["rcept_no"], "queue": ["id"]}


class Conflict(Exception):
    """Another writer has changed what this transaction read or wrote."""


class _Files:
    """The few operations on the file system that a commit needs, on whichever system the path is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file as a whole under a name that is free; False if it is taken."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            self.context.rename(self.path(beside), self.path(name), options)
        except Py4JJavaError as error:
            self.fs.delete(self.path(beside), False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def under(self, folder: str) -> list[str]:
        found, each = [], self.fs.listFiles(self.path(folder), True)
        while each.hasNext():
            path = each.next().getPath()
            if path.getName().endswith(".parquet"):
                found.append(path.toString())
        return found


class Store:
    """The snapshots under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    def version(self) -> int:
        """The number of the latest snapshot; 0 if there is none."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.read(self._at(version))) if version else {"tables": {}}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as a snapshot has it (the latest, if none is named)."""
        return self._frame(self.manifest(version)["tables"][table])

    def begin(self) -> Transaction:
        return Transaction(self)

    def _at(self, version: int) -> str:
        return f"{self.root}/manifests/{version:010d}.json"

    def _frame(self, held: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        paths = [p for b, ps in held["files"].items() if buckets is None or b in buckets for p in ps]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)


class Transaction:
    """Changes of any number of tables, which commit() makes visible at once."""

    def __init__(self, store: Store):
        self.store, self.id = store, uuid.uuid4().hex
        self.base = store.version()
        self.tables: dict[str, dict] = store.manifest(self.base)["tables"]
        self.touched: dict[str, set[str]] = {}
        self.replaced: set[str] = set()

    def read(self, table: str) -> DataFrame:
        """The table as this transaction has left it. A commit fails if others have changed it meanwhile."""
        self.touched.setdefault(table, set()).update(self.tables[table]["files"])
        return self.store._frame(self.tables[table])

    def put(self, table: str, df: DataFrame, keys: list[str] | None = None, buckets: int = 16) -> DataFrame:
        """Replaces a table, or makes it."""
        held = self.tables.get(table)
        keys = keys or (held["keys"] if held else KEYS[table])
        made = {"schema": df.schema.jsonValue(), "keys": keys, "buckets": held["buckets"] if held else buckets, "files": {}}
        made["files"] = self._written(table, df, made)
        self.tables[table] = made
        self.replaced.add(table)
        return self.store._frame(made)

    def upsert(self, table: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> set[str]:
        """Merges a batch into the buckets that it has keys in, and returns these. merge: (current rows, batch) to new rows, key by key."""
        held = self.tables[table]
        bucket = self._bucket(held)
        touched = {str(r[0]) for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most the number of buckets
        if touched:
            self.touched.setdefault(table, set()).update(touched)
            merged = merge(self.store._frame(held, touched), batch)
            files = {b: ps for b, ps in held["files"].items() if b not in touched} | self._written(table, merged, held)
            self.tables[table] = held | {"files": files}
        return touched

    def publish(self, table: str, df: DataFrame) -> DataFrame:
        """put(), as run_pipeline calls it; exports, which are no tables of the model, stay plans."""
        return self.put(table, df) if table in KEYS else df

    def commit(self) -> int:
        """The number of the snapshot that holds these changes."""
        at = self.base
        while True:
            newest = self.store.version()
            if newest > at:
                self._rebase(self.store.manifest(at)["tables"], self.store.manifest(newest)["tables"])
                at = newest
            said = json.dumps({"version": at + 1, "parent": at, "transaction": self.id, "tables": self.tables}, ensure_ascii=False)
            if self.store.files.create(self.store._at(at + 1), said):
                return at + 1

    def _rebase(self, was: dict[str, dict], now: dict[str, dict]) -> None:
        for table in now.keys() | was.keys():
            old, new = (t.get(table, {"files": {}})["files"] for t in (was, now))
            changed = {b for b in old.keys() | new.keys() if old.get(b) != new.get(b)}
            if changed and (table in self.replaced or changed & self.touched.get(table, set())):
                raise Conflict(f"{table}: buckets {sorted(changed)}")
            if not changed:
                continue
            if table in self.touched:
                kept = {b: ps for b, ps in self.tables[table]["files"].items() if b in self.touched[table]}
                self.tables[table] = now[table] | {"files": {b: ps for b, ps in new.items() if b not in self.touched[table]} | kept}
            else:
                self.tables[table] = now[table]

    @staticmethod
    def _bucket(held: dict):
        return F.pmod(F.xxhash64(*held["keys"]), F.lit(held["buckets"]))

    def _written(self, table: str, df: DataFrame, held: dict) -> dict[str, list[str]]:
        """Writes rows to files of their own, one a bucket, and returns these by bucket, as paths under the root."""
        folder = f"data/{table}/{self.id}-{uuid.uuid4().hex[:8]}"
        dealt = df.withColumn(BUCKET, self._bucket(held)).repartition(held["buckets"], BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        files: dict[str, list[str]] = {}
        for path in sorted(self.store.files.under(f"{self.store.root}/{folder}")):
            own = path[path.index(f"/{folder}/") + 1 :]
            files.setdefault(own.split(f"{BUCKET}=")[1].split("/")[0], []).append(own)
        return files


def upsert_model(tx: Transaction, nodes: DataFrame | None = None, edges: DataFrame | None = None, facts: DataFrame | None = None) -> dict[str, set[str]]:
    """Upserts batches of the model's tables in one transaction; returns the buckets that each touched.

    Of rows of one key in a batch the last by label, source_ref or amount stays.
    """
    out = {}
    if nodes is not None:
        out["nodes"] = tx.upsert("nodes", nodes, lambda old, new: upsert.upsert_nodes(old, new, [F.col("label")]))
    if edges is not None:
        out["edges"] = tx.upsert("edges", edges, lambda old, new: upsert.upsert_edges(old, new, [F.desc("source_ref")]))
    if facts is not None:
        out["facts"] = tx.upsert("facts", facts, lambda old, new: upsert.upsert_facts(old, new, [F.desc("amount")]))
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n, and sum and exclusive or of the rows' hashes. Equal for equal tables in any order, so a rebuild can be proved equal."""
    rows = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))
