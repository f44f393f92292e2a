"""What a run does with each repo, and the lock that keeps runs apart. Driver-side: one row a repo, no DataFrames."""

from __future__ import annotations

import contextlib
import fcntl
import os
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass
class RepoState:
    """What is known of a repo: whether it has a graph, the digests recorded and found, and what was refused."""

    has_graph: bool = True
    recorded_code: str | None = None
    recorded_semantic: str | None = None
    code: str = ""
    semantic: str = ""
    recipe: int = 3
    recorded_recipe: int | None = None
    producer_changed: bool = False
    drift: bool = False
    ast_only: bool = False
    refused: str | None = None
    granted: bool = False


def decide(s: RepoState) -> str:
    """bootstrap, update, extract or skip.

    Without a graph: bootstrap. Without a record: update. Another recipe, with equal texts or not: update. Changed
    texts: extract; update if only code is read; skip if the same texts were refused once and not granted since.
    Changed code, another producer, or a graph that drifted: update.
    """
    if not s.has_graph:
        return "bootstrap"
    if s.recorded_code is None:
        return "update"
    if s.recorded_recipe is not None and s.recorded_recipe != s.recipe:
        return "update"
    if s.semantic != s.recorded_semantic:
        if s.ast_only:
            return "update"
        return "skip" if s.refused == s.semantic and not s.granted else "extract"
    return "update" if s.code != s.recorded_code or s.producer_changed or s.drift else "skip"


def in_grace(failing_since: float | None, now: float, hours: float) -> bool:
    """A repo whose infrastructure has failed for less than that many hours does not count against a run."""
    return failing_since is not None and 0 <= now - failing_since < hours * 3600


class LockHeld(RuntimeError):
    pass


@contextlib.contextmanager
def transaction(path: str) -> Iterator[None]:
    """One run at a time; a second one is refused at once."""
    fd = os.open(path, os.O_CREAT | os.O_RDWR, 0o600)
    try:
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise LockHeld(path) from e
        yield
    finally:
        os.close(fd)


def open_permissions(paths: list[str]) -> list[str]:
    """Files that hold secrets and that others than their owner can read."""
    return [p for p in paths if os.path.exists(p) and os.stat(p).st_mode & 0o077]


def orphans(ps: str, watched: list[str]) -> list[int]:
    """Process ids in the output of ps (pid, ppid, command) that run a watched program and whose parent is gone or is init."""
    rows = [(int(a), int(b), c) for a, b, c in (x.split(None, 2) for x in ps.splitlines() if x.strip() and x.split()[0].isdigit())]
    live = {pid for pid, _, _ in rows}
    return sorted(pid for pid, parent, cmd in rows if any(w in cmd for w in watched) and (parent == 1 or parent not in live))
