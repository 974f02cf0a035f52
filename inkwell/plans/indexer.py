"""Incremental indexing: found files to a new snapshot. What changed is decided on hashes; contents are read of changed files alone."""

from __future__ import annotations

import os
import sys
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import Workspace, canonical
from inkwell.embed import embedded, known_dim
from inkwell.functions import text as T
from inkwell.functions.markdown import section_structs
from inkwell.operators.changes import change_actions, first_root_wins, pruned
from inkwell.plans.snapshot import Snapshot
from inkwell.sources.vault import contents, read_vaults


#: Changed files that one task reads and parses.
FILES_PER_TASK = 256


@dataclass
class Report:
    scanned: int = 0
    indexed: int = 0
    skipped: int = 0
    deleted: int = 0
    chunks: int = 0


def chunk_rows(docs: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """(path, ord, heading_path, text): windows of each section of `body`, numbered through the document."""
    sections = docs.select("path", section_structs(F.col("body")).alias("sections"))
    pieces = F.transform("sections", lambda s: F.transform(T.windows(s["text"], max_tokens, overlap), lambda w: F.struct(s["heading_path"].alias("heading_path"), w.alias("text"))))
    return sections.select("path", F.posexplode(F.flatten(pieces)).alias("ord", "x")).select("path", "ord", "x.heading_path", "x.text")


def ship(spark: SparkSession) -> None:
    """Let Python workers of a session that was started elsewhere import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def guard_model(meta: dict[str, str], model: str, force: bool) -> None:
    if not force and meta.get("model.text", model) != model:
        raise ValueError(f"the index was built with model {meta['model.text']!r}, the config names {model!r}; run rebuild")


def run(spark: SparkSession, ws: Workspace, roots: list[str], force: bool = False, fresh: bool = False, now: int | None = None, found: DataFrame | None = None) -> Report:
    """Index the roots. `force` re-embeds unchanged files too, `fresh` also forgets what is stored; `found` gives the files of a
    root instead of a walk, and then nothing is pruned.

    A missing root is warned about and its documents stay. Documents under a walked root that were not found are removed. An
    unchanged file keeps all its stored columns. Nothing is published if any step fails. Steps are written to the store's folder
    until the run ends, so a lost executor costs its tasks only and all tables see one reading of each file.
    """
    ship(spark)
    store = Snapshot(spark, ws.store)
    model, chunking = ws.config.embed.text.model, ws.config.chunk
    dim = known_dim(model)
    meta = store.meta()
    guard_model(meta, model, force)
    settings = f"{chunking.max_tokens}/{chunking.overlap}"
    if not force and meta.get("chunk", settings) != settings:
        print(f"warning: chunk settings changed from {meta['chunk']} to {settings}; unchanged files keep their chunks until rebuild", file=sys.stderr)
    walked = []
    for root in roots:
        if real := canonical(root):
            walked.append(real)
        else:
            print(f"warning: skipping missing vault {root}", file=sys.stderr)
    stored = store.table("documents")
    if fresh:
        stored = stored.limit(0)

    staging = f"run-{uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        path = store.files.at(f"{staging}/{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        prune = found is None
        found = staged(read_vaults(spark, walked, ws.config.ignore.globs) if prune else found, "found")
        scanned = found.count()
        acted = staged(change_actions(first_root_wins(found), stored, force), "acted")
        counts = {r["action"]: r["count"] for r in acted.groupBy("action").count().collect()}
        todo = acted.where("action = 'index'").drop("action", "root_ord")
        read = contents(todo.repartition(max(1, -(-counts.get("index", 0) // FILES_PER_TASK))))
        parsed = staged(read.withColumn("note", T.parsed(F.col("path"), T.lossy_utf8(F.col("content")))).drop("content"), "parsed")
        stamp = F.lit(int(time.time()) if now is None else now).cast("long")
        docs = parsed.select("path", "kind", "source_root", "content_hash", "mtime", F.col("note.title").alias("title"), F.col("note.frontmatter").alias("frontmatter"), stamp.alias("indexed_at"))
        pieces = chunk_rows(parsed.select("path", F.col("note.body").alias("body")), chunking.max_tokens, chunking.overlap)
        chunks = pieces.select("path", "ord", F.lit("text").alias("space"), F.lit("text").alias("modality"), "text", "heading_path", embedded(T.embed_input(F.col("heading_path"), F.col("text")), model).alias("vector"))
        links = parsed.select(F.col("path").alias("src_path"), F.explode("note.links").alias("dst"))
        dead = staged(pruned(stored, found, walked if prune else []).select("path"), "dead")
        deleted = dead.count()
        gone = dead.unionByName(todo.select("path"))
        store.publish(gone, {"documents": docs, "chunks": chunks, "links": links}, {"model.text": model, "dim.text": str(dim), "chunk": settings}, stored.count() + counts.get("index", 0), fresh)
        new = store.table("chunks").join(todo.select("path"), "path", "left_semi").count() if counts.get("index") else 0
        return Report(scanned, counts.get("index", 0), counts.get("skip", 0), deleted, new)
    finally:
        store.files.delete(staging)


def forget(spark: SparkSession, ws: Workspace, root: str) -> int:
    """Remove the documents of a root, with their chunks and links; how many documents there were."""
    store = Snapshot(spark, ws.store)
    if not store.exists():
        return 0
    docs = store.table("documents")
    dead = docs.where(F.col("source_root") == root).select("path")
    n = dead.count()
    if n:
        store.publish(dead, {}, store.meta(), docs.count())
    return n
