"""Commits of a log store: which catalogue tables, and so which files, make up the log at a version.

A commit is one small file ``commits/<version>.json``; what it names is written before, under names nobody
else uses, and never changed or moved. So a reader sees a commit whole or not at all, on an object store
as on a disk, and what a failed attempt left behind is in no commit. One job writes to a store at a time.
"""

import json
from dataclasses import asdict, dataclass, field

from logweir.sources import files


@dataclass(frozen=True)
class Commit:
    """A version of the log. ``added`` lists the files with new rows, for followers; merging adds none.

    ``catalogs`` are the folders of all live catalogue rows, ``retired`` the files that this version replaced.
    ``state`` has one row per sink (``schemas.STATE``): what the next batch goes on from.
    """

    version: int
    batch: int
    catalogs: tuple[str, ...]
    state: tuple[tuple, ...] = field(default=())
    next_seq: int = 0
    added: tuple[dict, ...] = field(default=())
    retired: tuple[str, ...] = field(default=())


def _path(out: str, version: int) -> str:
    return f"{out}/commits/{version:020d}.json"


def versions(out: str) -> list[int]:
    """Versions in order, from the names of one flat folder."""
    return sorted(int(n.removesuffix(".json")) for n in files.names(f"{out}/commits") if n.endswith(".json") and n[0] != "_")


def read_commit(out: str, version: int) -> Commit:
    found = json.loads(files.read(_path(out, version)))
    found["state"] = [tuple(row) for row in found["state"]]
    return Commit(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def latest(out: str) -> Commit | None:
    """The newest version; None for a store without commits."""
    found = versions(out)
    return read_commit(out, found[-1]) if found else None


def commit(out: str, new: Commit) -> None:
    """Make ``new`` the newest version."""
    path = _path(out, new.version)
    if files.exists(path):
        raise FileExistsError(f"{path}: another writer has committed this version")
    files.put(path, json.dumps(asdict(new)).encode())


def forget(out: str, keep: int) -> int:
    """Remove the commits older than the newest ``keep``; how many."""
    old = versions(out)[:-keep]
    return sum(files.delete_file(_path(out, v)) for v in old)
