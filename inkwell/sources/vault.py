"""Spark data source `vault`: Markdown files under one or more roots, with .gitignore and ignore-glob rules."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from inkwell.schema import FOUND

FILES_PER_TASK, FOLDERS = 256, 256


def glob_regex(glob: str) -> str:
    """A gitignore pattern without its `!`, leading and trailing slash, as a regular expression over a relative path."""
    out, k = "", 0
    while k < len(glob):
        if glob[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "[" and (end := glob.find("]", k + 2)) > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif glob[k] == "[":
            raise ValueError(f"bad glob {glob!r}: unclosed class")
        elif glob[k] == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return out


class Rules:
    """Ordered gitignore rules of one directory; the last that matches decides."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            line = line.rstrip("\r\n")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + glob_regex(line.removeprefix("/")) + r"\Z", re.S), only_dirs, keep))

    def verdict(self, relative: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept in spite of earlier rules; None: nothing said."""
        for pattern, only_dirs, keep in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.match(relative):
                return not keep
        return None


class Walker:
    """The rules under which files of a canonical root are found: hidden and ignored ones are left out, symlinks are not followed.

    .gitignore files count inside a git repository, those above the root too.
    """

    def __init__(self, root: str, globs: list[str]):
        self.root, self.own = root, Rules(list(globs))
        start = Path(root)
        repository = next((p for p in (start, *start.parents) if (p / ".git").exists()), None)
        self.in_repository = repository is not None
        chain = [p for p in reversed(start.parents) if p == repository or repository in p.parents] if repository else []
        self.outer = [(str(p), r) for p in chain if (r := _read_rules(p))]

    def within(self, folder: str, rules: list[tuple[str, Rules]]) -> list[tuple[str, Rules]]:
        """The rules that hold in a folder, given those around it."""
        return [*rules, (folder, r)] if self.in_repository and (r := _read_rules(Path(folder))) else rules

    def admits(self, path: str, is_dir: bool, rules: list[tuple[str, Rules]]) -> bool:
        if os.path.basename(path).startswith(".") or self.own.verdict(os.path.relpath(path, self.root), is_dir):
            return False
        return not next((v for base, r in reversed(rules) if (v := r.verdict(os.path.relpath(path, base), is_dir)) is not None), False)

    def entries(self, folder: str, rules: list[tuple[str, Rules]]) -> Iterator[tuple[str, bool]]:
        """Admitted subfolders and Markdown files of a folder, in order of name; and whether each is a folder. rules: within() the folder."""
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in found:
            is_dir = e.is_dir(follow_symlinks=False)
            if (is_dir or e.is_file(follow_symlinks=False) and is_note(e.name)) and self.admits(e.path, is_dir, rules):
                yield e.path, is_dir

    def walk(self, folder: str, around: list[tuple[str, Rules]]) -> Iterator[str]:
        rules = self.within(folder, around)
        for path, is_dir in self.entries(folder, rules):
            if is_dir:
                yield from self.walk(path, rules)
            else:
                yield path

    def finds(self, path: str) -> bool:
        """Whether a walk of the root would find this file."""
        if not path.startswith(self.root.rstrip("/") + "/") or not is_note(os.path.basename(path)):
            return False
        folder, rules = self.root, self.outer
        *folders, _ = os.path.relpath(path, self.root).split("/")
        for name in [*folders, None]:
            rules = self.within(folder, rules)
            at = path if name is None else f"{folder.rstrip('/')}/{name}"
            if os.path.islink(at) or not self.admits(at, name is not None, rules):
                return False
            folder = at
        return os.path.isfile(path)


def is_note(name: str) -> bool:
    return name.lower().endswith(".md") and name.lower() != ".md"


def discover(root: str, globs: list[str]) -> Iterator[str]:
    """Regular Markdown files under a canonical root in path order."""
    walker = Walker(root, globs)
    yield from walker.walk(root, walker.outer)


def _read_rules(folder: Path) -> Rules | None:
    try:
        return Rules((folder / ".gitignore").read_text(encoding="utf-8", errors="replace").split("\n"))
    except OSError:
        return None


class _Work(InputPartition):
    """Files, and folders to walk with the rules around them, of one root."""

    def __init__(self, root: str, ord_: int, paths: list[str], folders: list[tuple[str, list]]):
        self.root, self.ord, self.paths, self.folders = root, ord_, paths, folders


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], globs: list[str], files_per_task: int, folders: int):
        self.roots, self.globs, self.step, self.folders = roots, globs, files_per_task, folders

    def partitions(self) -> list[InputPartition]:
        """The driver lists folders level by level, only until there are enough of them; tasks walk what is below."""
        out = []
        for k, root in enumerate(self.roots):
            walker = Walker(root, self.globs)
            level, paths = [(root, walker.outer)], []
            while level and len(level) < self.folders:
                below = []
                for folder, around in level:
                    rules = walker.within(folder, around)
                    for path, is_dir in walker.entries(folder, rules):
                        below.append((path, rules)) if is_dir else paths.append(path)
                level = below
            out += [_Work(root, k, paths[i : i + self.step], []) for i in range(0, len(paths), self.step)]
            out += [_Work(root, k, [], [f]) for f in level]
        return out

    def read(self, partition: InputPartition | None):
        if not partition:
            return
        walker = Walker(partition.root, self.globs)
        walked = (p for folder, around in partition.folders for p in walker.walk(folder, around))
        for path in (*partition.paths, *walked):
            if got := fingerprint(path):
                yield os.path.realpath(path), "markdown", partition.root, partition.ord, *got[:2]


def fingerprint(path: str) -> tuple[int, bytes, bytes] | None:
    """Modification time, SHA-256 and content of a regular file; None if it is gone, as if it had been before the walk."""
    try:
        with open(path, "rb") as f:
            info, content = os.fstat(f.fileno()), f.read()
    except FileNotFoundError:
        return None
    return (max(0, int(info.st_mtime)), hashlib.sha256(content).digest(), content) if stat.S_ISREG(info.st_mode) else None


class VaultSource(DataSource):
    """Files with their hashes, without their content. Options: `roots` (JSON list of canonical folders that all workers see), `globs` (JSON
    list), `filesPerTask`, `folders` (how many folders the driver lists before tasks walk on)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self):
        return FOUND

    def reader(self, schema):
        o = self.options
        return _Reader(json.loads(o["roots"]), json.loads(o.get("globs", "[]")), int(o.get("filesPerTask", FILES_PER_TASK)), int(o.get("folders", FOLDERS)))


def read_vaults(spark: SparkSession, roots: list[str], globs: list[str], **options: int) -> DataFrame:
    """Files of the canonical roots, as many times as they are found; a bad glob raises here."""
    Rules(list(globs))
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").options(roots=json.dumps(roots), globs=json.dumps(globs), **options).load()


def found_among(paths: DataFrame, root: str, globs: list[str]) -> DataFrame:
    """The rows that read_vaults() would give for those of paths(path) that a walk of the one root would find."""
    Rules(list(globs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walker = Walker(root, globs)
        for batch in batches:
            rows = [(os.path.realpath(p), "markdown", root, 0, *got[:2]) for p in batch["path"] if walker.finds(p) and (got := fingerprint(p))]
            yield pd.DataFrame(rows, columns=FOUND.names)

    return paths.select("path").mapInPandas(run, FOUND)


def contents(found: DataFrame) -> DataFrame:
    """found with `content`, read where the rows are; mtime and hash are those of what is read, and a file that is gone gives no row."""
    names = found.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):  # one file at a time, so that large ones don't add up
                if got := fingerprint(row["path"]):
                    yield pd.DataFrame([row | dict(zip(("mtime", "content_hash", "content"), got))], columns=[*names, "content"])

    return found.mapInPandas(run, StructType([*found.schema.fields, StructField("content", BinaryType())]))
