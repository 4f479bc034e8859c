"""Which files an input names."""

from __future__ import annotations

import fnmatch
import os
from pathlib import Path

from pyarrow import fs


def listed(paths: list[str], recursive: bool = False, pattern: str = "*") -> list[tuple[str, int]]:
    """Files and their sizes, each once, sorted by path. Folders are searched for files that match the pattern, hidden ones
    left out, links followed; a file that is named must match too. FileNotFoundError for what isn't there."""
    found: dict[str, int] = {}
    for path in paths:
        if "://" in path and not path.startswith("file:"):
            found |= _remote(path, recursive, pattern)
            continue
        at = Path(path.removeprefix("file://").removeprefix("file:"))
        if not at.exists():
            raise FileNotFoundError(path)
        for file in [at] if at.is_file() else _walk(at, recursive):
            if fnmatch.fnmatch(file.name, pattern):
                found[str(file)] = file.stat().st_size
    return sorted(found.items())


def _walk(folder: Path, recursive: bool):
    if not recursive:
        yield from (p for p in folder.iterdir() if p.is_file() and not p.name.startswith("."))
        return
    for root, dirs, names in os.walk(folder, followlinks=True):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        yield from (Path(root, n) for n in names if not n.startswith(".") and Path(root, n).is_file())


def _remote(uri: str, recursive: bool, pattern: str) -> dict[str, int]:
    system, inner = fs.FileSystem.from_uri(uri)
    base = uri[: len(uri) - len(inner)] if uri.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=recursive))
    return {base + i.path: i.size for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(".") and fnmatch.fnmatch(i.base_name, pattern)}


def existing(paths: list[str], recursive: bool = False, pattern: str = "*") -> list[str]:
    """As listed(), paths only; an empty result raises, as tools need inputs."""
    if not (found := [p for p, _ in listed(paths, recursive, pattern)]):
        raise AssertionError("no input files")
    return found
