"""Versioned snapshots of an index: Parquet folders by hash of the path, a manifest that names them, and one pointer file that is swapped."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.changes import replaced
from inkwell.plans.storage import Storage
from inkwell.schema import KEYS, TABLES

SCHEMA_VERSION = "2"
#: About as many documents share a bucket; an edit rewrites the buckets of the documents that it touches.
DOCS_PER_BUCKET = 10_000


class Snapshot:
    """An index in a folder or URI that driver and workers share. Single writer; readers keep the version that they opened."""

    def __init__(self, spark: SparkSession, store: str | Path):
        self.spark, self.files = spark, Storage(spark, store)

    def version(self) -> str | None:
        return self.files.read("CURRENT").strip() if self.files.exists("CURRENT") else None

    def exists(self) -> bool:
        return self.version() is not None

    def manifest(self, version: str | None = None) -> dict:
        version = version or self.version()
        if version is None:
            return {"meta": {}, "buckets": 0, "tables": {name: {} for name in TABLES}}
        return json.loads(self.files.read(f"{version}/manifest.json"))

    def table(self, name: str) -> DataFrame:
        """A table of the current version, an empty one of its schema where nothing is published yet."""
        return self._read(name, self.manifest()["tables"][name].values())

    def _read(self, name: str, folders) -> DataFrame:
        paths = [self.files.at(f) for f in folders]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def meta(self) -> dict[str, str]:
        return self.manifest()["meta"]

    def publish(self, gone: DataFrame, new: dict[str, DataFrame], meta: dict[str, str], documents: int, fresh: bool = False) -> None:
        """Make the next version: without the rows of the paths in gone(path), with the rows of new by table.

        Only buckets that hold such a path are written; the others are taken over from the version before. `documents` is about how many there
        will be; where they have outgrown the buckets fourfold, or with `fresh`, which forgets all that is stored, the number of
        buckets is chosen anew. A failure before the swap of the pointer leaves the index as it was.
        """
        before = self.version()
        old = self.manifest()
        if fresh:
            old |= {"buckets": 0, "tables": {name: {} for name in TABLES}}
        wanted = max(1, -(-documents // DOCS_PER_BUCKET))
        anew = not old["buckets"] or wanted > 4 * old["buckets"]
        buckets = wanted if anew else old["buckets"]
        name = f"v{int(before[1:]) + 1 if before else 1:06d}"
        self.files.delete(name)  # left by a run that did not come to the swap
        bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        paths = gone.select("path").unionByName(new["documents"].select("path")) if "documents" in new else gone.select("path")
        touched = None if anew else {str(r[0]) for r in paths.select(bucket("path")).distinct().collect()}
        tables = {}
        for table, schema in TABLES.items():
            key = KEYS[table]
            folders = old["tables"][table]
            kept = self._read(table, [f for k, f in folders.items() if touched is None or k in touched])
            rows = replaced(kept, gone.select(F.col("path").alias(key)), new.get(table, kept.limit(0)), key).select(*schema.names)
            self._write(rows, bucket(key), f"{name}/{table}", len(touched) if touched is not None else buckets)
            written = self._buckets(f"{name}/{table}", touched if touched is not None else map(str, range(buckets)))
            tables[table] = {k: f for k, f in folders.items() if touched is not None and k not in touched} | written
        manifest = {"schema_version": SCHEMA_VERSION, "before": before, "meta": meta | {"schema_version": SCHEMA_VERSION}, "buckets": buckets, "tables": tables}
        self.files.write(f"{name}/manifest.json", json.dumps(manifest))
        self.files.write("CURRENT", name)
        if before:
            self._drop_unused(self.manifest(before), manifest)

    def _write(self, rows: DataFrame, bucket: Column, folder: str, parts: int) -> None:
        if parts:
            rows.withColumn("bucket", bucket).repartition(parts, "bucket").write.partitionBy("bucket").parquet(self.files.at(folder))

    def _buckets(self, folder: str, numbers) -> dict[str, str]:
        """Those of the buckets that have rows."""
        return {k: f"{folder}/bucket={k}" for k in numbers if self.files.exists(f"{folder}/bucket={k}")}

    def _drop_unused(self, before: dict, current: dict) -> None:
        """Delete what only the version before the one before needed; readers of the last two go on."""
        oldest = before["before"]
        if not oldest or not self.files.exists(f"{oldest}/manifest.json"):
            return
        used = {f for m in (before, current) for t in m["tables"].values() for f in t.values()}
        for folders in self.manifest(oldest)["tables"].values():
            for folder in set(folders.values()) - used:
                self.files.delete(folder)
        self.files.delete(f"{oldest}/manifest.json")
