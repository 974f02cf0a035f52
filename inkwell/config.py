"""Settings in TOML, and the places of a local or the global index."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path

CONFIG_FILE = "inkwell.toml"
HOME_DIR = ".inkwell"
MODELS = {"bge-small-en-v1.5": 384, "bge-base-en-v1.5": 768, "all-MiniLM-L6-v2": 384, "nomic-embed-text-v1.5": 768}


@dataclass
class TextModel:
    model: str = "bge-small-en-v1.5"


@dataclass
class ImageModel:
    enabled: bool = False
    model: str = "clip-vit-b-32"


@dataclass
class Embed:
    text: TextModel = field(default_factory=TextModel)
    image: ImageModel = field(default_factory=ImageModel)


@dataclass
class Chunking:
    max_tokens: int = 384
    overlap: int = 64

    def __post_init__(self) -> None:
        if self.max_tokens < 1 or self.overlap < 0:
            raise ValueError("chunk.max_tokens must be at least 1 and chunk.overlap at least 0")


@dataclass
class Pdf:
    enabled: bool = True


@dataclass
class Ignore:
    globs: list[str] = field(default_factory=lambda: ["node_modules/**", ".git/**", f"{HOME_DIR}/**"])


@dataclass
class Obsidian:
    auto: bool = True


@dataclass
class Config:
    vaults: list[str] = field(default_factory=lambda: ["."])
    db_dir: str = HOME_DIR
    embed: Embed = field(default_factory=Embed)
    chunk: Chunking = field(default_factory=Chunking)
    pdf: Pdf = field(default_factory=Pdf)
    ignore: Ignore = field(default_factory=Ignore)
    obsidian: Obsidian = field(default_factory=Obsidian)

    @classmethod
    def load(cls, explicit: str | Path | None = None) -> Config:
        """The explicit file, which must exist; else the one in the working directory; else defaults. Unknown keys are ignored."""
        path = Path(explicit or CONFIG_FILE)
        if not path.exists():
            if explicit:
                raise FileNotFoundError(f"no config at {path}")
            return cls()
        with path.open("rb") as f:
            return _filled(cls(), tomllib.load(f))

    def to_toml(self) -> str:
        return _toml(asdict(self))


def _filled(base, given: dict):
    new = {}
    for f in fields(base):
        if f.name in given:
            old = getattr(base, f.name)
            value = _filled(old, given[f.name]) if is_dataclass(old) else given[f.name]
            if type(value) is not type(old):
                raise TypeError(f"{f.name}: expected {type(old).__name__}")
            new[f.name] = value
    return replace(base, **new)


def _toml(tree: dict, prefix: str = "") -> str:
    """Plain values first, then a section for each nested table."""
    value = lambda v: "true" if v is True else "false" if v is False else json.dumps(v, ensure_ascii=False)
    plain = "".join(f"{k} = {value(v)}\n" for k, v in tree.items() if not isinstance(v, dict))
    head = f"[{prefix[:-1]}]\n" if prefix and plain else ""
    nested = [_toml(v, f"{prefix}{k}.") for k, v in tree.items() if isinstance(v, dict)]
    return "\n".join(filter(None, [head + plain, *nested]))


def expand(path: str | Path) -> Path:
    """A leading `~` component is the home directory; `~name` is left as it is."""
    path = Path(path)
    return Path.home().joinpath(*path.parts[1:]) if path.parts[:1] == ("~",) else path


def canonical(path: str | Path) -> str | None:
    """Absolute path without symlinks, None where nothing is there."""
    try:
        return str(expand(path).resolve(strict=True))
    except OSError:
        return None


@dataclass
class Workspace:
    config: Config
    config_path: Path
    #: A local path, or a URI of a file system that Hadoop knows.
    store: str | Path
    is_global: bool = False

    @classmethod
    def resolve(cls, is_global: bool = False, explicit: str | Path | None = None) -> Workspace:
        if is_global and explicit:
            raise ValueError("--global can't be used with --config")
        if is_global:
            home = Path.home() / HOME_DIR
            path = home / "config.toml"
            return cls(Config.load(path) if path.exists() else Config(vaults=[]), path, home / "global.index", True)
        path = Path(explicit or CONFIG_FILE)
        config = Config.load(explicit)
        store = f"{config.db_dir.rstrip('/')}/local.index" if "://" in config.db_dir else path.parent / config.db_dir / "local.index"
        return cls(config, path, store)

    def roots(self) -> list[str]:
        return [str(expand(v)) for v in self.config.vaults]

    def save_config(self) -> None:
        self.config_path.parent.mkdir(parents=True, exist_ok=True)
        self.config_path.write_text(self.config.to_toml(), encoding="utf-8")
