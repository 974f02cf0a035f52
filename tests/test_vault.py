import hashlib
import os
from pathlib import Path

import pytest

from inkwell import cli
from inkwell.config import Config, Workspace, canonical
from inkwell.operators.search import search
from inkwell.plans import indexer
from inkwell.plans.snapshot import Snapshot
from inkwell.sources import vault as vault_source
from inkwell.sources.vault import Rules, discover
from inkwell.streaming import ingest

NOTES = {
    "coffee.md": "---\ntitle: Brewing Coffee\n---\n\n# Brewing Coffee\n\nHeat water and pour slowly.\n\n## Grind\n\nA medium grind works. See [[espresso]].\n",
    "espresso.md": "# Espresso\n\nForce hot water through coffee.\n\n## Tamping\nTamp the grounds.\n",
    "rust.md": "# Borrow Checker\n\nOwnership rules at compile time.\n",
    "bread.md": "# Sourdough\n\nWild yeast starter.\n\n## Feeding\n\nDiscard half and feed.\n",
}


@pytest.fixture
def vault(tmp_path):
    for name, text in NOTES.items():
        (tmp_path / "vault").mkdir(exist_ok=True)
        (tmp_path / "vault" / name).write_text(text, encoding="utf-8")
    config = Config(vaults=[str(tmp_path / "vault")])
    return Workspace(config, tmp_path / "inkwell.toml", tmp_path / "index")


def counts(r):
    return r.scanned, r.indexed, r.skipped, r.deleted, r.chunks


def test_lifecycle(spark, vault, tmp_path, capsys):
    run = lambda **k: counts(indexer.run(spark, vault, vault.roots(), now=7, **k))
    root = tmp_path / "vault"
    assert run() == (4, 4, 0, 0, 7)
    assert run() == (4, 0, 4, 0, 0)
    store = Snapshot(spark, vault.store)
    assert {r["title"] for r in store.table("documents").collect()} == {"Brewing Coffee", "Espresso", "Borrow Checker", "Sourdough"}
    assert [tuple(r) for r in store.table("links").collect()] == [(str(root / "coffee.md"), "espresso")]
    assert sorted((Path(r["path"]).name, r["ord"], r["heading_path"]) for r in store.table("chunks").collect())[:2] == [("bread.md", 0, "Sourdough"), ("bread.md", 1, "Sourdough > Feeding")]
    (root / "rust.md").write_text("# Borrow Checker\n\nEdited.\n")
    (root / "bread.md").unlink()
    (root / "empty.md").write_text("")
    (root / "_draft.md").write_bytes(b"bad \xff byte")
    assert run() == (5, 3, 2, 1, 2)
    assert run(force=True) == (5, 5, 0, 0, 6)
    hits = cli.query(spark, vault, "medium grind of coffee").collect()
    assert hits[0]["title"] == "Brewing Coffee" and hits[0]["heading_path"] == "Brewing Coffee > Grind" and [h["rank"] for h in hits] == list(range(1, 5))
    assert cli.query(spark, vault, "x", limit=0).collect() == []
    with pytest.raises(FileNotFoundError):
        cli.query(spark, vault, "x", roots=[str(tmp_path / "missing")])
    assert "notes     5" in cli.describe(spark, vault) and "model" in cli.describe(spark, vault)
    vault.config.embed.text.model = "all-MiniLM-L6-v2"
    with pytest.raises(ValueError):
        run()
    with pytest.raises(ValueError):
        cli.query(spark, vault, "x")
    assert cli.rebuild(spark, vault) == "5 notes indexed, 6 windows written."
    assert cli.forget(spark, vault, str(root)).endswith("removed 5 document(s) and unregistered the vault.")
    assert store.table("chunks").count() == store.table("links").count() == 0
    with pytest.raises(ValueError):
        cli.rebuild(spark, vault)


def test_roots_are_scoped(spark, vault, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "b.md").write_text("# B\n\ncoffee coffee\n")
    indexer.run(spark, vault, [*vault.roots(), str(other)])
    store = Snapshot(spark, vault.store)
    assert cli.query(spark, vault, "coffee", roots=[str(other)]).count() == 1
    assert indexer.forget(spark, vault, "/nowhere") == 0
    (other / "b.md").unlink()
    assert counts(indexer.run(spark, vault, vault.roots())) == (4, 0, 4, 0, 0)
    assert store.table("documents").count() == 5
    assert counts(indexer.run(spark, vault, [str(other), str(tmp_path / "gone")])) == (0, 0, 0, 1, 0)
    assert counts(indexer.run(spark, vault, [*vault.roots(), *vault.roots()])) == (8, 0, 4, 0, 0)


def test_command_line(spark, vault, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path / "vault")
    main = lambda *a: (cli.main(list(a), spark), capsys.readouterr())
    assert main("status")[1].out.startswith("No index found")
    assert main("search", "x")[0] == 1
    assert main("init")[0] == 0 and main("init")[0] == 1 and main("init", "--force")[0] == 0
    assert "Of 4 notes 4 indexed, 0 as they were; 0 gone. 7 windows written." in main("index")[1].out
    out = main("search", "borrow checker ownership", "--full", "--limit", "1")[1].out.splitlines()
    assert out[0].startswith(" 1. [") and "Borrow Checker  (" in out[0] and out[1].startswith("      § Borrow")
    assert '"rank":1' in main("search", "coffee", "--json")[1].out
    assert "espresso.md" not in main("related", "coffee.md")[1].out and "espresso.md" in main("related", "coffee.md", "--include-linked")[1].out
    assert main("-g", "-c", "x.toml", "status")[0] == 1


def tree(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith("."))


def test_publish_rewrites_touched_buckets_only(spark, vault, tmp_path, monkeypatch):
    monkeypatch.setattr("inkwell.plans.snapshot.DOCS_PER_BUCKET", 1)
    run = lambda: counts(indexer.run(spark, vault, vault.roots(), now=7))
    assert run() == (4, 4, 0, 0, 7)
    store = Snapshot(spark, vault.store)
    first = store.manifest()
    assert first["buckets"] == 4
    rows = lambda: sorted(map(str, store.table("chunks").collect() + store.table("documents").collect()))
    before = rows()
    (tmp_path / "vault" / "rust.md").write_text("# Borrow Checker\n\nEdited.\n")
    assert run() == (4, 1, 3, 0, 1)
    second = store.manifest()
    changed = [k for k, f in second["tables"]["documents"].items() if f != first["tables"]["documents"].get(k)]
    assert len(changed) == 1 and len(second["tables"]["documents"]) > 1
    assert [r for r in rows() if "rust.md" not in r] == [r for r in before if "rust.md" not in r] and rows() != before
    assert run() == (4, 0, 4, 0, 0) and run() == (4, 0, 4, 0, 0)
    used = {f for t in store.manifest()["tables"].values() for f in t.values()}
    assert {str(Path(p).parent) for p in tree(vault.store) if p.endswith(".parquet")} == used
    for k in range(30):
        (tmp_path / "vault" / f"n{k}.md").write_text(f"# N{k}\n\nbody {k}\n")
    assert run() == (34, 30, 4, 0, 30) and store.manifest()["buckets"] == 34 and store.table("documents").count() == 34
    assert indexer.forget(spark, vault, str(tmp_path / "vault")) == 34 and store.table("chunks").count() == 0 == store.table("documents").count()


def test_a_failed_run_leaves_the_index_as_it_was(spark, vault, tmp_path, monkeypatch):
    indexer.run(spark, vault, vault.roots())
    store = Snapshot(spark, vault.store)
    before, version = tree(vault.store), store.version()
    (tmp_path / "vault" / "new.md").write_text("# New\n")
    monkeypatch.setattr(Snapshot, "_buckets", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        indexer.run(spark, vault, vault.roots())
    assert store.version() == version and store.table("documents").count() == 4 and set(before) <= set(tree(vault.store))
    monkeypatch.undo()
    assert counts(indexer.run(spark, vault, vault.roots()))[:2] == (5, 1)


def test_tasks_walk_below_the_folders_that_the_driver_lists(spark, tmp_path):
    for name in ("a.md", "x/b.md", "x/y/c.md", "x/y/z/d.md", "w/e.md", "w/out/f.md", ".git/g.md", "v/.h/i.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "w/.gitignore").write_text("out/\n")
    root = canonical(tmp_path)
    want = sorted((p, Path(p).read_bytes()) for p in discover(root, []))
    assert len(want) == 5
    for folders in (1, 2, 3, 100):
        found = vault_source.read_vaults(spark, [root], [], folders=folders)
        assert sorted(r["path"] for r in found.collect()) == [p for p, _ in want]
    assert sorted((r["path"], bytes(r["content"])) for r in vault_source.contents(found).collect()) == want
    assert all(hashlib.sha256(r["content"]).digest() == r["content_hash"] for r in vault_source.contents(found).collect())
    (tmp_path / "a.md").unlink()
    assert vault_source.contents(found.where("path LIKE '%/a.md'")).count() == 0


def test_stream_indexes_what_it_sees(spark, vault, tmp_path):
    root = tmp_path / "vault"
    (root / ".hidden").mkdir()
    (root / ".hidden" / "no.md").write_text("# No\n")
    (root / "with space+%.md").write_text("# Odd name\n\nx\n")
    step = lambda: ingest.watch(spark, vault, str(root), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    step()
    store = Snapshot(spark, vault.store)
    assert {Path(r["path"]).name for r in store.table("documents").collect()} == {*NOTES, "with space+%.md"}
    (root / "late.md").write_text("# Late\n\ny\n")
    (root / "rust.md").unlink()
    version = store.version()
    step()
    assert store.version() != version and store.table("documents").count() == 6
    assert counts(indexer.run(spark, vault, vault.roots())) == (5, 0, 5, 1, 0)


def test_finds_agrees_with_the_walk(tmp_path):
    names = ("a.md", "X.MD", "n.txt", ".h/x.md", "_d.md", "node_modules/a.md", "sub/b.md", "out/c.md", "out/keep.md", ".md")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("/out/*\n!keep.md\n")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    root = canonical(tmp_path)
    walker = vault_source.Walker(root, ["node_modules/**"])
    assert {p for n in (*names, "link/b.md", "gone.md") if walker.finds(p := f"{root}/{n}")} == set(discover(root, ["node_modules/**"]))
    assert not walker.finds("/elsewhere/a.md")


def test_discovery(tmp_path):
    for name in ("a.md", "X.MD", "notes.txt", ".hidden/x.md", "_draft.md", "with space.md", "node_modules/a.md", "sub/node_modules/b.md", ".md", "out/c.md", "out/keep.md", "deep/out/d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    found = lambda: [os.path.relpath(p, tmp_path) for p in discover(canonical(tmp_path), ["node_modules/**"])]
    assert found() == ["X.MD", "_draft.md", "a.md", "deep/out/d.md", "out/c.md", "out/keep.md", "sub/node_modules/b.md", "with space.md"]
    (tmp_path / ".gitignore").write_text("/out/*\n!keep.md\nsub/\n*space*\n")
    assert "out/c.md" in found()
    (tmp_path / ".git").mkdir()
    assert found() == ["X.MD", "_draft.md", "a.md", "deep/out/d.md", "out/keep.md"]
    with pytest.raises(ValueError):
        Rules(["[a"])


def test_scores(spark):
    docs = spark.createDataFrame([("a", "A", "/r"), ("b", "B", "/r"), ("c", "C", "/s"), ("d", "D", "/s")], "path string, title string, source_root string")
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("b", 0, [1.0, 0.0]), ("c", 0, [float("nan"), 0.0]), ("c", 1, None), ("a", 2, [9.0])]
    chunks = spark.createDataFrame([(p, o, "text", "text", f"t{o}", f"h{o}", v) for p, o, v in rows], "path string, ord int, space string, modality string, text string, heading_path string, vector array<float>")
    got = [(r["rank"], r["path"], r["text"], r["score"]) for r in search(docs, chunks, [1.0, 0.0]).collect()]
    assert got == [(1, "a", "t0", 1.0), (2, "b", "t0", 1.0), (3, "c", "", float("-inf"))]
    assert [r["path"] for r in search(docs, chunks, [1.0, 0.0], roots=["/s"]).collect()] == ["c"]


def test_config_round_trip(tmp_path):
    path = tmp_path / "c.toml"
    c = Config(vaults=["a", "b \"q\""])
    c.chunk.overlap = 3
    path.write_text(c.to_toml())
    assert Config.load(path) == c
    with pytest.raises(FileNotFoundError):
        Config.load(tmp_path / "none.toml")
    path.write_text("[chunk]\nmax_tokens = 0\n")
    with pytest.raises(ValueError):
        Config.load(path)
