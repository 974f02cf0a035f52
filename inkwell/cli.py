"""Command line: init, index, search, related, forget, status, rebuild."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkwell.config import CONFIG_FILE, HOME_DIR, Config, Workspace, canonical, expand
from inkwell.embed import embedder
from inkwell.functions.text import result_line, root_label, snippet
from inkwell.operators.changes import counts_by_root, status
from inkwell.operators.search import related, search
from inkwell.plans import indexer
from inkwell.plans.snapshot import Snapshot


def session() -> SparkSession:
    spark = SparkSession.builder.appName("inkwell").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def init(is_global: bool, force: bool) -> str:
    path, config = (Path.home() / HOME_DIR / "config.toml", Config(vaults=[])) if is_global else (Path(CONFIG_FILE), Config())
    if path.exists() and not force:
        raise FileExistsError(f"{path} is there already; --force overwrites it")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(config.to_toml(), encoding="utf-8")
    return f"Wrote {path}"


def index_roots(ws: Workspace, path: str | None) -> list[str]:
    """Local: the path instead of the config's vaults. Global: the path is registered and indexed alone."""
    if not ws.is_global:
        return [path] if path else ws.roots()
    if path:
        real = canonical(path)
        if real is None:
            raise FileNotFoundError(f"can't resolve {path}")
        if real not in {canonical(v) for v in ws.config.vaults}:
            ws.config.vaults.append(real)
            ws.save_config()
        return [real]
    if not ws.config.vaults:
        raise ValueError(f"no vaults are registered; index one by its path, or add some to {ws.config_path}")
    return ws.roots()


def index(spark: SparkSession, ws: Workspace, path: str | None = None) -> str:
    roots = index_roots(ws, path)
    print(f"{len(roots)} folder(s) to look through")
    r = indexer.run(spark, ws, roots)
    return f"Of {r.scanned} notes {r.indexed} indexed, {r.skipped} as they were; {r.deleted} gone. {r.chunks} windows written."


def rebuild(spark: SparkSession, ws: Workspace) -> str:
    """Roots are checked first, and the old index serves until the new one is complete."""
    roots = ws.roots()
    if not roots:
        raise ValueError(f"no vaults are registered to rebuild; add some to {ws.config_path}")
    print("A new index is made; the old one serves until it is whole")
    r = indexer.run(spark, ws, roots, force=True, fresh=True)
    return f"{r.indexed} notes indexed, {r.chunks} windows written."


def opened(spark: SparkSession, ws: Workspace) -> Snapshot:
    store = Snapshot(spark, ws.store)
    if not store.exists():
        raise FileNotFoundError(f"no index found at {ws.store}; run index first")
    indexer.guard_model(store.meta(), ws.config.embed.text.model, force=False)
    return store


def query(spark: SparkSession, ws: Workspace, text: str, roots: list[str] | None = None, limit: int = 10, spaces: list[str] | None = None):
    """Hits as a DataFrame. Unresolvable roots are warned about; if none resolves, that is an error and not a search of everything."""
    store = opened(spark, ws)
    real = []
    for r in roots or ():
        if c := canonical(r):
            real.append(c)
        else:
            print(f"warning: can't resolve {r}", file=sys.stderr)
    if roots and not real:
        raise FileNotFoundError("no given vault can be resolved")
    vector = embedder(ws.config.embed.text.model).embed([text])[0]
    return search(store.table("documents"), store.table("chunks"), vector, limit, real, spaces or ["text"])


def printed(hits, show_root: bool, full: bool) -> str:
    tag = F.concat(F.lit("["), F.coalesce(root_label(F.col("source_root")), F.lit("")), F.lit("] ")) if show_root else F.lit("")
    rows = hits.orderBy("rank").select(result_line(F.col("rank"), F.col("score"), tag, F.col("title"), F.col("path")).alias("line"), "heading_path", snippet(F.col("text")).alias("snippet")).collect()
    out = []
    for r in rows:
        out.append(r["line"])
        if r["heading_path"]:
            out.append(f"      § {r['heading_path']}")
        if full:
            out.append(f"      {r['snippet']}")
    return "\n".join(out) or "No results."


def as_json(df) -> str:
    return "\n".join(df.orderBy("rank").toJSON().collect())


def forget(spark: SparkSession, ws: Workspace, path: str) -> str:
    """The folder need not exist any more: its literal absolute path is then meant."""
    real = canonical(path) or str(expand(path).absolute())
    left = [v for v in ws.config.vaults if (canonical(v) or str(expand(v).absolute())) != real]
    gone = len(left) < len(ws.config.vaults)
    n = indexer.forget(spark, ws, real)
    if gone:
        ws.config.vaults = left
        ws.save_config()
    return f"Forgot {real}: removed {n} document(s){' and unregistered the vault' if gone else ''}."


def describe(spark: SparkSession, ws: Workspace) -> str:
    store = Snapshot(spark, ws.store)
    if not store.exists():
        return f"No index found at {ws.store}; run index first."
    docs = store.table("documents")
    s = status(docs, store.table("chunks")).first()
    out = [
        f"scope     {'all folders of this user' if ws.is_global else 'this folder'}",
        f"settings  {ws.config_path}",
        f"index     {ws.store}",
        f"model     {store.meta().get('model.text', ws.config.embed.text.model)}",
        f"notes     {s['documents']}",
        f"windows   {s['chunks_text']} of text, {s['chunks_image']} of images",
        f"updated   {'-' if s['indexed_at'] is None else s['indexed_at']} (Unix seconds)",
    ]
    counts = counts_by_root(docs).collect()
    if len(counts) > 1:
        out += [f"notes     {r['documents']} in {r['source_root']}" for r in counts]
    return "\n".join(out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkwell", description="Semantic search over folders of Markdown notes")
    p.add_argument("-c", "--config")
    p.add_argument("-g", "--global", dest="is_global", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true")
    sub.add_parser("index").add_argument("path", nargs="?")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--from", dest="roots", action="append", default=[])
    s.add_argument("--in", dest="spaces", action="append", default=[])
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--full", action="store_true")
    s.add_argument("--json", action="store_true")
    r = sub.add_parser("related")
    r.add_argument("file")
    r.add_argument("--limit", type=int, default=10)
    r.add_argument("--include-linked", action="store_true")
    r.add_argument("--json", action="store_true")
    sub.add_parser("forget").add_argument("path")
    sub.add_parser("status")
    sub.add_parser("rebuild")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "init":
            print(init(a.is_global, a.force))
            return 0
        ws = Workspace.resolve(a.is_global, a.config)
        spark = spark or session()
        if a.command == "index":
            print(index(spark, ws, a.path))
        elif a.command == "search":
            hits = query(spark, ws, a.query, a.roots, a.limit, a.spaces)
            print(as_json(hits) if a.json else printed(hits, ws.is_global or len(ws.config.vaults) > 1, a.full))
        elif a.command == "related":
            store = opened(spark, ws)
            hits = related(store.table("documents"), store.table("chunks"), store.table("links"), canonical(a.file) or a.file, a.limit, a.include_linked)
            print(as_json(hits) if a.json else "\n".join(f"{r['rank']:>2}. [{r['score']:.3f}] {r['title']}  ({r['path']})" for r in hits.collect()) or "No results.")
        elif a.command == "forget":
            print(forget(spark, ws, a.path))
        elif a.command == "status":
            print(describe(spark, ws))
        else:
            print(rebuild(spark, ws))
    except (OSError, ValueError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
