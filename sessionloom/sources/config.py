"""Settings from a TOML file; whatever it leaves out has its default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from .scan import SKIP_FOLDERS


@dataclass
class Source:
    """A folder of artifacts: name, path and kind of assistant."""

    name: str
    path: str
    kind: str


@dataclass
class Settings:
    sources: list[Source] = field(default_factory=list)
    warehouse: str = "~/sessionloom"
    backups: str = "~/sessionloom-backups"
    skip_folders: list[str] = field(default_factory=lambda: list(SKIP_FOLDERS))
    exclude: list[str] = field(default_factory=list)
    redact: bool = True
    patterns: list[str] = field(default_factory=list)
    approve_at: float = 0.8
    concurrency: int = 5
    interval_minutes: int = 60
    retention_days: int = 0


def load(path: str | None) -> Settings:
    """Settings of a file; an absent file gives the defaults, unknown keys are ignored, ~ is expanded."""
    data: dict = {}
    if path is not None and os.path.exists(path):
        with open(path, "rb") as f:
            data = tomllib.load(f)
    known = {f.name for f in fields(Settings)}
    settings = Settings(**{k: v for k, v in data.items() if k in known and k != "sources"})
    settings.sources = [Source(s["name"], os.path.expanduser(s["path"]), s["kind"]) for s in data.get("sources", [])]
    settings.warehouse, settings.backups = os.path.expanduser(settings.warehouse), os.path.expanduser(settings.backups)
    if settings.interval_minutes < 1 or settings.concurrency < 1:
        raise ValueError("interval_minutes and concurrency must be at least 1")
    return settings


def all_sources(configured: list[Source], discovered: list[Source]) -> list[Source]:
    """Configured sources first, then discovered ones whose path is not among them."""
    return list({s.path: s for s in [*reversed(discovered), *reversed(configured)]}.values())[::-1]


# Fixed values: (name, folder below the home folder, kind) of further sources; of the first one only nested folders are.
APPLICATION = "Library/Application Support/Claude"
AGENTS = ("claude-desktop-agent", f"{APPLICATION}/local-agent-mode-sessions", "claude")
SOURCES = [("claude-desktop-code", f"{APPLICATION}/claude-code-sessions", "claude"), ("gemini", ".gemini", "gemini"), ("codex", ".codex", "codex")]
NESTED, DEPTH = ".claude", 6


def nested(root: str, name: str = NESTED, depth: int = DEPTH) -> list[str]:
    """Folders of a name at most ``depth`` levels below the folders in ``root``, in order; none inside another, links as in the listing.

    Folders that cannot be read count as empty.
    """
    found = []
    for at, folders, _ in os.walk(root):
        level = 0 if at == root else os.path.relpath(at, root).count(os.sep) + 1
        found += [os.path.join(at, f) for f in folders if f == name]
        folders[:] = [] if level >= depth else sorted(f for f in folders if f != name)
    return sorted(found)


def discovered(home: str) -> list[Source]:
    """The further sources that exist below a home folder of this machine; ``all_sources`` adds them to the configured ones."""
    name, folder, kind = AGENTS
    found = [Source(name, path, kind) for path in nested(os.path.join(home, folder))]
    return found + [Source(n, os.path.join(home, f), k) for n, f, k in SOURCES if os.path.isdir(os.path.join(home, f))]
