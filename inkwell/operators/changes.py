"""Relational steps of incremental indexing: first root wins, change detection, pruning, snapshot composition, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_root_wins(found: DataFrame, key: str = "path", order: str = "root_ord") -> DataFrame:
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def change_actions(found: DataFrame, stored: DataFrame, force: bool = False, key: str = "path", hash_: str = "content_hash") -> DataFrame:
    """found with `action`: `skip` where the stored hash is the same and nothing is forced, else `index`. One left join for all paths."""
    known = stored.select(key, F.col(hash_).alias("_known"))
    same = F.col("_known").isNotNull() & F.col(hash_).eqNullSafe(F.col("_known")) & F.lit(not force)
    return found.join(known, key, "left").withColumn("action", F.when(same, "skip").otherwise("index")).drop("_known")


def pruned(stored: DataFrame, seen: DataFrame, walked: Sequence[str] | DataFrame, key: str = "path", root: str = "source_root") -> DataFrame:
    """Stored rows under a walked root that were not seen; other roots' rows are never pruned. walked: names, or a table with the root column."""
    if isinstance(walked, DataFrame):
        return stored.join(walked.select(root).distinct(), root, "left_semi").join(seen.select(key), key, "left_anti")
    if not walked:
        return stored.limit(0)
    return stored.where(F.col(root).isin(*walked)).join(seen.select(key), key, "left_anti")


def replaced(old: DataFrame, gone: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Old rows without the gone keys, and the new rows."""
    return old.join(gone.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def paths_for_roots(documents: DataFrame, roots: Sequence[str]) -> DataFrame:
    return documents.where(F.col("source_root").isin(*roots)).select("path") if roots else documents.select("path").limit(0)


def status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks_text, chunks_image, indexed_at."""
    d = documents.agg(F.count("*").alias("documents"), F.max("indexed_at").alias("indexed_at"))
    c = chunks.agg(F.count_if(F.col("space") == "text").alias("chunks_text"), F.count_if(F.col("space") == "image").alias("chunks_image"))
    return d.crossJoin(c).select("documents", "chunks_text", "chunks_image", "indexed_at")


def counts_by_root(documents: DataFrame, root: str = "source_root") -> DataFrame:
    return documents.groupBy(F.col(root).alias("source_root")).agg(F.count("*").alias("documents")).orderBy("source_root")
